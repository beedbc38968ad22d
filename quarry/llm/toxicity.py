"""Toxicity by compression distance: zstandard dictionaries of toxic and ordinary text."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, hash_sample, ship, text_of, tidy, type_of

#: Bytes of a window and of each dictionary's own content, of each pair of dictionaries that votes.
VOTES = ((64, 700), (80, 700), (96, 700), (112, 700))
LEVEL = 3
#: A window counts if its gain is as high as that of at most this share of ordinary windows.
WINDOW_RATE = 0.1
#: Windows' worth of ordinary text that is added to a text, so that short ones aren't judged on luck.
PRIOR = 4
POOLED = ""
#: Windows (of the first vote's size) of the runs that are judged by themselves, besides the whole text.
RUNS = (8, 16, 32, 64)
#: Cuts of runs are taken from blocks of held-out text of so many times their length, if there are
#: so many blocks, by the share of the blocks that is taken for the tail.
BLOCK, LEAST_BLOCKS, TAIL = 4, 20, 0.1
#: How many times as often as in other texts a word is in those whose words a dictionary is of.
RATE = 10
#: Least log-likelihood ratio of such a word.
EVIDENCE = 5.0
#: The lowest cut, however few ordinary texts calibrate it.
LEAST_CUT = 2.0
_COLUMNS = [("windows", pa.int64()), ("score", pa.float64()), ("toxic", pa.bool_())]


class Vote(NamedTuple):
    """A pair of dictionaries; least: bytes that it must save in a window that counts; mean, sd: of
    the gains that count, 0 for other windows, in ordinary text."""

    ordinary: bytes
    toxic: bytes
    window: int
    least: int = 1
    mean: float = 0.0
    sd: float = 1.0


class Cut(NamedTuple):
    """What the deviation of the best of a text's runs exceeds as often in ordinary text of any
    length: ``at`` in text of ``windows`` windows, more by ``slope`` for each e-fold of them."""

    at: float
    windows: float
    slope: float

    def of(self, n: int) -> float:
        return max(LEAST_CUT, self.at + self.slope * np.log(n / self.windows))


class Model(NamedTuple):
    """cut: of whole texts; runs: of the runs of each length."""

    votes: list[Vote]
    cut: float
    runs: dict[int, Cut]


def windows(text: str, size: int) -> list[bytes]:
    """The whole text in pieces of about ``size`` bytes that end at spaces where they can."""
    data = text.lower().encode("utf-8", "replace")
    out, i, n = [], 0, len(data)
    while i < n:
        j = i + size
        if j < n:
            k = data.find(b" ", j, j + size)
            j = k if k >= 0 else j
        out.append(data[i:j])
        i = j
    return out


def compressors(v: Vote) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    made = []
    for data in (v.ordinary, v.toxic):
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made[0], made[1]


def gains(text: str, pair, window: int) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window over the ordinary one; less than 0 where
    the ordinary one saves more."""
    ordinary, toxic = pair[0].compress, pair[1].compress
    return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text, window)], dtype=np.int64)


def counting(text: str, pair, v: Vote) -> np.ndarray:
    """The gains of the windows that reach the calibrated threshold, 0 for the others."""
    return over(gains(text, pair, v.window), v.least)


def over(g: np.ndarray, least: int) -> np.ndarray:
    return np.where(g >= least, g, 0).astype(np.float64)


def threshold(found: list[np.ndarray], rate: float = WINDOW_RATE) -> int:
    """The least gain that no more than ``rate`` of the windows reach."""
    flat = np.concatenate(found) if found else np.zeros(0, np.int64)
    if not len(flat):
        return 1
    values, n = np.unique(flat, return_counts=True)
    reach = np.cumsum(n[::-1])[::-1] / len(flat)
    fits = np.flatnonzero(reach <= rate)
    return int(values[fits[0]]) if len(fits) else int(values[-1]) + 1


def deviation(g: np.ndarray, mean: float, sd: float) -> float:
    """How many standard deviations the gains that count lie over ordinary text's."""
    return float((g - mean).sum() / (sd * np.sqrt(len(g) + PRIOR)))


def best_run(g: np.ndarray, k: int, mean: float, sd: float) -> float:
    """The greatest deviation of ``k`` windows in succession."""
    sums = np.concatenate(([0.0], np.cumsum(g)))
    k = min(k, len(g))
    return float(((sums[k:] - sums[:-k]).max() - k * mean) / (sd * np.sqrt(k + PRIOR)))


def run_deviation(each: list[np.ndarray], votes: list[Vote], run: int) -> float:
    """Mean of the votes' greatest deviations in runs of the bytes of ``run`` windows of the first."""
    return float(np.mean([best_run(g, max(1, round(run * votes[0].window / v.window)), v.mean, v.sd) for v, g in zip(votes, each)]))


def judge(each: list[np.ndarray], m: Model) -> float:
    """The greatest deviation, of the whole text or of a run in it, in parts of its cut."""
    n = len(each[0])
    if not n:
        return 0.0
    most = float(np.mean([deviation(g, v.mean, v.sd) for v, g in zip(m.votes, each)])) / m.cut
    return max([most, *(run_deviation(each, m.votes, r) / c.of(n) for r, c in m.runs.items() if n > r)])


def score(text: str, m: Model, pairs) -> tuple[int, float]:
    """(windows, what :func:`judge` says of those that count)"""
    each = [counting(text, p, v) for v, p in zip(m.votes, pairs)]
    return len(each[0]), judge(each, m)


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary; of samples too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _spread(texts: list[str]) -> Counter:
    """How many texts have each word."""
    return Counter(w for t in texts for w in set(t.lower().split()))


def _evidence(n: int, of: int, k: int, among: int) -> float:
    """Log-likelihood ratio of n of ``of`` and k of ``among`` against one rate for both."""

    def log(n: int, of: int, rate: float) -> float:
        return (n * np.log(rate) if n else 0.0) + ((of - n) * np.log(1 - rate) if n < of else 0.0)

    p = (n + k) / (of + among)
    return log(n, of, n / of) - log(n, of, p) + (log(k, among, k / among) - log(k, among, p) if among else 0.0)


def _novel(texts: list[str], known: Counter, of: int) -> list[bytes]:
    """What ``texts`` say more often than others, ``of`` texts of which ``known`` have each word:
    runs of the words of EVIDENCE of which a share of the texts has RATE times that of the
    others, these with half a text more. Neither words nor runs are limited in number."""
    spread = _spread(texts)
    more = {w: n for w, n in spread.items() if n / len(texts) >= RATE * (known[w] + 0.5) / (of + 1)}
    use = {w for w, n in more.items() if _evidence(n, len(texts), known[w], of) >= EVIDENCE}
    out = []
    for t in texts:
        x = [w for w in t.lower().split() if w in use]
        out += [(" " + " ".join(x[i : i + 4]) + " ").encode("utf-8", "replace") for i in range(0, len(x), 4)]
    return out


def _split(texts: list[str], salt: int, of: int, first: int) -> tuple[list[str], list[str]]:
    """Texts in two parts by a hash, ``first`` of ``of`` in the first."""
    parts: tuple[list[str], list[str]] = ([], [])
    for t in texts:
        parts[zlib.crc32(t.encode("utf-8", "replace"), salt) % of >= first].append(t)
    return parts


def train(ordinary: list[str], toxic: list[str], false_rate: float = 0.005, base_bytes: int = 30_000, votes=VOTES) -> Model:
    """Both dictionaries of a pair begin with the same content, trained on all windows of part of
    the ordinary texts, so that what they differ in is small; then each has content of its own,
    trained on the words that toxic texts, or other ordinary ones, have more often than that
    part. Pairs of different windows and parts vote. A window counts if the bytes that the toxic
    dictionary saves reach a threshold calibrated on windows of the ordinary texts held out of
    all pairs (:func:`threshold`). The cuts are such that ``false_rate`` of these texts exceed
    one: of the deviation of whole texts, and of the best runs in them (:func:`run_cuts`)."""
    toxic = sorted(set(toxic))
    train_on, held = _split(sorted(set(ordinary)), 0, 5, 3)
    out, each = [], []
    for k, (window, own) in enumerate(votes):
        base, other = _split(train_on, k + 1, 3, 2)
        shared = _trained([w for t in base for w in windows(t, window)], base_bytes, 64, 8)
        known = _spread(base)
        v = Vote(shared + _trained(_novel(other, known, len(base)), own, 12, 6), shared + _trained(_novel(toxic, known, len(base)), own, 12, 6), window)
        pair = compressors(v)
        found = [gains(t, pair, window) for t in held]
        v = v._replace(least=threshold(found))
        found = [over(g, v.least) for g in found]
        flat = np.concatenate(found) if found else np.zeros(1)
        out.append(v._replace(mean=float(flat.mean()), sd=float(flat.std()) or 1.0))
        each.append(found)
    if not held:
        return Model(out, float("inf"), {})
    by_text = [list(g) for g in zip(*each) if len(g[0])]
    whole = [float(np.mean([deviation(g, v.mean, v.sd) for v, g in zip(out, e)])) for e in by_text]
    m = Model(out, max(_exceeded(whole, false_rate), LEAST_CUT), run_cuts(by_text, out, false_rate))
    # Any of several cuts may be exceeded, so all are raised.
    more = max(1.0, _exceeded([judge(e, m) for e in by_text], false_rate))
    return Model(out, m.cut * more, {r: Cut(c.at * more, c.windows, c.slope * more) for r, c in m.runs.items()})


def _exceeded(values: list[float], rate: float) -> float:
    """What a share of ``rate`` of the values exceeds."""
    return sorted(values)[min(len(values) - 1, int(np.ceil(len(values) * (1 - rate))))] if values else float("inf")


def run_cuts(by_text: list[list[np.ndarray]], votes: list[Vote], false_rate: float) -> dict[int, Cut]:
    """The cuts of the runs, from gains of held-out texts. Texts are joined to blocks; the tail
    of their best runs is taken as exponential and carried on to any number of windows."""
    out = {}
    for run in RUNS:
        blocks, held = [], []
        for e in by_text:
            held.append(e)
            if sum(len(x[0]) for x in held) >= BLOCK * run:
                blocks.append([np.concatenate(g) for g in zip(*held)])
                held = []
        if len(blocks) < LEAST_BLOCKS:
            continue
        best = np.sort([run_deviation(b, votes, run) for b in blocks])
        start = best[int(len(best) * (1 - TAIL))]
        over = best[best > start] - start
        slope = max(float(over.mean()) if len(over) else 0.0, 0.25)
        out[run] = Cut(float(start + slope * np.log(TAIL / false_rate)), float(np.mean([len(b[0]) for b in blocks])), slope)
    return out


def train_models(rows: list[tuple[str | None, str, int]], least_toxic: int = 30, least_ordinary: int = 200, **options) -> dict[str, Model]:
    """A model of all rows (language, text, toxic or not) under POOLED, and one of each
    language with enough of both kinds."""
    groups: dict[str, tuple[list[str], list[str]]] = {POOLED: ([], [])}
    for lang, text, toxic in rows:
        for key in {POOLED, lang or POOLED}:
            groups.setdefault(key, ([], []))[bool(toxic)].append(text)
    return {k: train(a, b, **options) for k, (a, b) in groups.items() if k == POOLED or (len(b) >= least_toxic and len(a) >= least_ordinary)}


def _score(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = models.value
        pairs = {k: [compressors(v) for v in m.votes] for k, m in value.items()}
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                key = lang if lang in value else POOLED
                n, s = score(text, value[key], pairs[key])
                out.append((n, s, n > 0 and s > 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(list(zip(*out)) or [()] * 3, _COLUMNS))], names=["doc_id", *(n for n, _ in _COLUMNS)])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``doc_id, windows, score, toxic`` for each row of ``docs``; ids are of any type.

    The dictionaries and cuts are trained on labelled documents (``labels``: the id, toxic),
    at most about ``max_rows`` of either kind, by a seeded hash. Each window of a whole text
    is compressed with both; a text is toxic if the gains that count, of the whole or of a run of
    windows anywhere in it, are over their cut (a score over 1); see :func:`train` and
    :func:`judge`. A language with too few labelled rows, or none (null, or no
    such column), is judged by the model of all languages. Null and empty texts have no windows,
    score 0 and aren't toxic; without labels nothing is toxic; an id that is labelled twice is
    toxic if one label says so; repeated rows and null ids are rows like any other; a score of
    just 1 isn't toxic; an empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    lang = col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows_of = docs.select(col(id_col).alias("doc_id"), lang.alias("lang"), text_of(text_col).alias("text"))
    known = labels.select(col(id_col).alias("doc_id"), col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    chosen = [hash_sample(known.where(F.col("toxic") == k), "doc_id", max_rows, seed, v) for k, v in n.items()]
    rows = []
    if chosen:
        some = chosen[0]
        for x in chosen[1:]:
            some = some.unionByName(x)
        # About 2 * max_rows rows at most, however many are labelled.
        rows = [(r[0], r[1], r[2]) for r in rows_of.join(F.broadcast(some), "doc_id").select("lang", "text", "toxic").collect()]
    models = spark.sparkContext.broadcast(train_models(rows, **options))
    return rows_of.mapInArrow(tidy(_score(models)), f"doc_id {type_of(docs, id_col)}, windows long, score double, toxic boolean")


def toxic_docs(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of :func:`toxicity` that are toxic."""
    return toxicity(docs, labels, **options).where("toxic")

"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, ship, text_of, tidy, type_of
from .words import KIND, SHOWN, VALUES, U, binary, chunks, powers, words_of

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of the longest unit. Longer runs, as of scripts without spaces, are several units.
WORD = 32
SPACE = 32
#: Share of a text that may be foreign to its language: names, numbers, keys.
NOISE = 0.05
#: Standard deviations that a text may fall below its language's own held-out texts of its length,
#: and the share of their median that is enough at any length.
SIGMAS, SHARE = 4.0, 1 / 4
#: Lengths in words at which held-out texts calibrate; between them the next shorter one counts.
LENGTHS = (1, 2, 4, 8, 16, 32, 64, 128, 256)
_SCHEMA = pa.schema([("lang", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("evidence", pa.float64()), ("words", pa.int64()), ("accepted", pa.bool_())])
OUT = "lang string, score double, margin double, evidence double, words long, accepted boolean"


def read_pieces(path: str) -> list[bytes]:
    """All pieces of a vocabulary, in the order of their ranks, and what bytes it lacks."""
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in (line.split() for line in f if line.strip()))
    pieces = [p for _, p in ranked]
    return pieces + [bytes([b]) for b in range(256) if bytes([b]) not in set(pieces)]


def background(pieces: int) -> np.ndarray:
    """Probabilities of the pieces in text of any language: by Zipf's law of their ranks, which are
    those of their frequency in the many languages that the vocabulary is of."""
    p = 1.0 / (100.0 + np.arange(pieces))
    return p / p.sum()


def spelled(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`words_of` for all that is shown: runs of letters and digits, and runs of other signs."""
    return words_of(texts, SHOWN, KIND, WORD)


def worded(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which units are words: of letters, without a digit. Signs, numbers and keys are of no language."""
    digits = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
    return (digits[stop] == digits[start]) & (KIND[data[start]] == 1)


class Vocabulary:
    """Looks up substrings by hash, many at once."""

    BITS, MORE = 20, 17

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.longest = pieces, max(map(len, pieces))
        keys = np.array([self.key(p) for p in pieces], dtype=np.uint64)
        assert len(set(keys.tolist())) == len(keys)
        self.first_key, self.first_id = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
        self.mult = U(0x9E3779B97F4A7C15)
        left = []
        for i, slot in enumerate(self.slots(keys, self.mult, self.BITS).tolist()):
            if self.first_id[slot] < 0:
                self.first_key[slot], self.first_id[slot] = keys[i], i
            else:
                left.append(i)
        self.filled = (self.first_id >= 0).astype(np.uint8)
        rng = np.random.Generator(np.random.PCG64(7))
        rest = keys[left]
        while True:  # a multiplier that gives the few others a slot each
            self.mult2 = U(int(rng.integers(1, 1 << 63)) | 1)
            slots = self.slots(rest, self.mult2, self.MORE)
            if len(set(slots.tolist())) == len(rest):
                break
        self.more_key, self.more_id = np.zeros(1 << self.MORE, np.uint64), np.full(1 << self.MORE, -1, np.int32)
        self.more_key[slots], self.more_id[slots] = rest, left

    @staticmethod
    def key(piece: bytes) -> int:
        p = powers(len(piece))[0]
        return int((VALUES[np.frombuffer(piece, np.uint8)] * p).sum(dtype=np.uint64))

    @staticmethod
    def slots(keys: np.ndarray, mult, bits: int) -> np.ndarray:
        return ((keys * mult) >> U(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are pieces, their ids)"""
        slot = self.slots(keys, self.mult, self.BITS)
        rows = np.flatnonzero(self.filled[slot])
        slot, hit = slot[rows], keys[rows]
        ids = np.where(self.first_key[slot] == hit, self.first_id[slot], -1)
        miss = np.flatnonzero(ids < 0)
        if len(miss):
            other = self.slots(hit[miss], self.mult2, self.MORE)
            ids[miss] = np.where(self.more_key[other] == hit[miss], self.more_id[other], -1)
            good = ids >= 0
            rows, ids = rows[good], ids[good]
        return rows, ids


def by_length(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, bytes after a space) of the words of each length up to WORD."""
    length = stop - start
    order = np.argsort(length, kind="stable")
    edges = np.searchsorted(length[order], np.arange(1, WORD + 2))
    for n in range(1, WORD + 1):
        at = order[edges[n - 1] : edges[n]]
        if len(at):
            words = np.empty((len(at), n + 1), np.uint8)
            words[:, 0] = SPACE
            words[:, 1:] = data[start[at][:, None] + np.arange(n)]
            yield at, words


def arcs(words: np.ndarray, vocabulary: Vocabulary) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, rows, pieces): the pieces that lie at each place of words of one length, by end."""
    n = words.shape[1]
    p, inverse = powers(n + 1)
    sums = np.zeros((n + 1, len(words)), np.uint64)
    np.cumsum((VALUES[words] * p[:n]).T, axis=0, out=sums[1:])
    out = []
    for to in range(1, n + 1):
        for at in range(max(0, to - vocabulary.longest), to):
            rows, ids = vocabulary.find((sums[to] - sums[at]) * inverse[at])
            if len(rows):
                out.append((at, to, rows, ids))
    return out


def forward(found, n: int, rows: int, p: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of the words' beginnings, by length: (n + 1, rows, languages)."""
    a = np.zeros((n + 1, rows, p.shape[1]))
    a[0] = 1
    for at, to, r, ids in found:
        if len(r) == rows:
            a[to] += a[at] * p[ids]
        else:
            a[to, r] += a[at, r] * p[ids]
    return a


class Model:
    """languages; p: probability of each piece by language, and in the last column in any text
    (:func:`background`); floors: least evidence a word by language and LENGTHS."""

    def __init__(self, pieces: list[bytes], languages: list[str], p: np.ndarray, floors: np.ndarray | None = None):
        self.vocabulary, self.languages, self.p = Vocabulary(pieces), languages, p
        self.floors = np.full((len(languages), len(LENGTHS)), -np.inf) if floors is None else floors

    def log_probabilities(self, data, start, stop) -> np.ndarray:
        """Of each unit, after a space, in each language and in any."""
        out = np.empty((len(start), self.p.shape[1]))
        for at, words in by_length(data, start, stop):
            for i in range(0, len(at), 20_000):
                part = words[i : i + 20_000]
                out[at[i : i + 20_000]] = np.log(forward(arcs(part, self.vocabulary), part.shape[1], len(part), self.p)[-1])
        return out

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-probability by language of each unit, that in any text, its bytes and whether it is a
        word, first unit of each text and the end). A word's in a language is that of its own
        pieces, or with NOISE of any's; other units have that of any text in all languages."""
        data, start, stop, hashes, first = spelled(texts)
        if not len(start):
            return np.zeros((0, len(self.languages))), np.zeros((0, 3)), first
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        start, stop = start[one], stop[one]
        log, words = self.log_probabilities(data, start, stop), worded(data, start, stop)
        mixed = np.where(words[:, None], np.logaddexp(log[:, :-1] + np.log1p(-NOISE), log[:, -1:] + np.log(NOISE)), log[:, -1:])
        rest = np.stack((log[:, -1], stop - start + 1.0, words.astype(np.float64)), axis=1)
        return mixed[which], rest[which], first

    def score(self, texts: list[bytes]) -> list[tuple]:
        """A row of _SCHEMA a text."""
        if not self.languages:
            return [(None, None, None, None, 0, True)] * len(texts)
        log, rest, first = self.units(texts)
        k, out = len(self.languages), []
        total = np.zeros((len(log) + 1, k + 3))
        np.cumsum(np.concatenate((log, rest), axis=1), axis=0, out=total[1:])
        for row in total[first[1:]] - total[first[:-1]]:
            n = round(row[k + 2])
            if not n:
                out.append((None, None, None, None, 0, False))
                continue
            order = np.argsort(-row[:k], kind="stable")
            best = int(order[0])
            margin = float(row[best] - row[order[1]]) if k > 1 else float("inf")
            evidence = float(row[best] - row[k]) / n
            out.append((self.languages[best], float(row[best] / row[k + 1]), margin, evidence, n, bool(evidence >= self.floor(best, n))))
        return out

    def floor(self, language: int, n: int) -> float:
        return self.floors[language, int(np.searchsorted(LENGTHS, n, side="right")) - 1]


def floors(model: Model, held: dict[str, list[bytes]]) -> np.ndarray:
    """The least evidence a word (by how much a language explains it better than :func:`background`)
    that a text needs: SIGMAS standard deviations below the median of the held-out texts' blocks
    of that many words, or SHARE of the median if that is less. The deviation is told from the
    median and the sixth of the blocks below: passages in other languages, which some texts
    have, don't widen it. Without 20 blocks those of the next shorter length count, at first none."""
    out = np.full((len(model.languages), len(LENGTHS)), -np.inf)
    for i, lang in enumerate(model.languages):
        log, rest, first = model.units(held.get(lang, []))
        words = rest[:, 2] > 0
        each = (log[:, i] - rest[:, 0])[words]
        first = np.concatenate(([0], np.cumsum(words)))[first]
        for j, n in enumerate(LENGTHS):
            blocks = [each[a : a + len(each[a:b]) // n * n].reshape(-1, n).mean(axis=1) for a, b in zip(first[:-1], first[1:])]
            means = np.concatenate(blocks) if blocks else np.zeros(0)
            if len(means) >= 20:
                low, middle = np.quantile(means, (0.1587, 0.5))
                out[i, j] = min(middle - SIGMAS * (middle - low), SHARE * middle)
            elif j:
                out[i, j] = out[i, j - 1]
    return out


def train(rows: list[tuple[str, bytes]], pieces: list[bytes], rounds: int = 4, smoothing: float = 0.5) -> Model:
    """Piece probabilities by expectation maximisation over all segmentations of each
    language's words, from (language, lower-case text). Of five texts one is held out and
    calibrates how much evidence a text needs (:func:`floors`)."""
    vocabulary = Vocabulary(pieces)
    languages = sorted({lang for lang, _ in rows})
    p, held = [], {}
    length = np.array([len(x) for x in pieces])
    for lang in languages:
        texts = sorted({t for x, t in rows if x == lang})
        held[lang] = [t for t in texts if zlib.crc32(t) % 5 == 0]
        texts = [t for t in texts if zlib.crc32(t) % 5] or texts
        data, start, stop, hashes, _ = spelled(texts)
        words = worded(data, start, stop)
        start, stop, hashes = start[words], stop[words], hashes[words]
        _, one, counts = np.unique(hashes, return_index=True, return_counts=True)
        start, stop = start[one], stop[one]
        groups = [(at, w.shape[1], arcs(w, vocabulary)) for at, w in by_length(data, start, stop)]
        q = (1.0 / len(pieces)) ** np.minimum(length, 3)
        q /= q.sum()
        for _ in range(rounds):
            expected = np.zeros(len(pieces))
            for at, n, found in groups:
                a = forward(found, n, len(at), q[:, None])[..., 0]
                b = np.zeros_like(a)
                b[n] = 1
                share = counts[at] / a[n]
                for low, high, r, ids in reversed(found):
                    here = q[ids] * b[high, r]
                    np.add.at(expected, ids, a[low, r] * here * share[r])
                    b[low, r] += here
            q = expected + smoothing / length
            q /= q.sum()
        p.append(q)
    model = Model(pieces, languages, np.array([*p, background(len(pieces))]).T)
    model.floors = floors(model, held)
    return model


def fit(docs: DataFrame, rows_each: int = 600, seed: int = 31, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", tokenizers: str = TOKENIZERS) -> Model:
    """Trains on about ``rows_each`` labelled documents of each language at most, chosen by a
    seeded hash of the id. ``tokenizers``: the folder that has the vocabulary."""
    lang = col(lang_col).cast("string")
    n = {r[0]: r[1] for r in docs.groupBy(lang.alias("lang")).count().collect() if r[0] is not None}
    share: Column = F.lit(0.0)
    for k, v in n.items():
        share = F.when(lang == k, F.lit(rows_each / v)).otherwise(share)
    spot = F.pmod(F.xxhash64(col(id_col), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = docs.where(lang.isNotNull() & (spot < share)).select(lang.alias("lang"), F.lower(text_of(text_col)).alias("text"))
    return train([(r[0], r[1].encode("utf-8", "replace")) for r in some.collect()], read_pieces(os.path.join(tokenizers, VOCABULARY)))


def _identify(model, texts: int):
    """texts: the column of the batches that has the text; it becomes the result's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            text = binary(batch.column(texts))
            for low, high in chunks(text):
                rows = m.score(text[low:high])
                part = batch.slice(low, high - low)
                kept = [i for i in range(batch.num_columns) if i != texts]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept] + [pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], names=[batch.schema.names[i] for i in kept] + _SCHEMA.names)

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, **options) -> DataFrame:
    """``doc_id, lang, score, margin, evidence, words, accepted`` for each row; ids are of any type.

    A text is in lower case and cut into units, runs of letters and digits and runs of other
    signs, of WORD bytes at most, each after a space. lang: the language under which it is most
    probable, summed over all segmentations of its units into pieces of the vocabulary, with
    NOISE of anything; ties go to the first by name. score: mean log-probability a byte;
    margin: by how much the log-probability exceeds the next language's; words: units of
    letters alone, others having one probability in all languages; evidence: by how much the
    log-probability of a word exceeds that in text of any language (:func:`background`).
    accepted: the evidence is not below what held-out texts of the language have at that length
    (:func:`floors`); a few words can't be told apart and are accepted.
    Null and empty texts, and those without words, have no language and aren't accepted;
    where no row has a label all are accepted with a null language. Null ids and repeated
    rows are rows like any other; an empty table gives none; other columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(docs, id_col=id_col, text_col=text_col, **options) if model is None else model)
    texts = docs.select(col(id_col).alias("doc_id"), F.lower(text_of(text_col)).alias("text"))
    return texts.mapInArrow(tidy(_identify(shared, 1)), f"doc_id {type_of(docs, id_col)}, {OUT}")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in a known language, with their own columns: see :func:`identify`."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(docs, id_col=id_col, text_col=text_col, **options))
    names, at = docs.columns, docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names with dots can't go to a worker
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields) + ", accepted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            text = [b"" if t is None else t for t in binary(pc.utf8_lower(batch.column(at)))]
            for low, high in chunks(text):
                flags = [r[5] for r in shared.value.score(text[low:high])]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(flags, pa.bool_())], names=[*batch.schema.names, "accepted"])

    return plain.mapInArrow(tidy(run), schema).where("accepted").drop("accepted").toDF(*names)

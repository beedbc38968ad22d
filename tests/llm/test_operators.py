"""Each operator against a brute-force version, and on awkward rows."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import compare
from pyspark.sql import functions as F

from quarry.llm import chat, html, langid, media, mixing, neardup, packing, quality, queries, sharding, toxicity
from quarry.llm import words as W

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", tokens int, key string, keep boolean, words string, rank int, bucket int, shard string, `__text` int, `a.b` int, accepted int, members int, cell int"
LONG = "word " * 60_000 + "x" * 5000


def awkward(spark):
    tail = (1, "k", None, "w", 0, 0, "s", 3, 4, 5, 6, 7)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 3), (None, "the cat and the dog sat here", "en", "s", 1), (4, "the cat and the dog sat here", "en", "s", 1), (4, "the cat and the dog sat here", "en", "s", 1), (5, LONG, None, "t", 1), (6, "été où ça ퟿ \U0001f600 naïve", "fr", "t", 1), (7, "the cat and the dog sat here", "en", "u", None)]
    return spark.createDataFrame([r + tail for r in rows], EXTRA)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# packing


def greedy(lengths, capacity):
    packs = []
    for n in sorted(lengths, reverse=True):
        room = [(capacity - sum(p), -i) for i, p in enumerate(packs) if capacity - sum(p) >= n]
        if room:
            packs[-max(room)[1]].append(n)
        else:
            packs.append([n])
    return packs


@pytest.mark.parametrize("seed", range(12))
def test_packing_equals_one_at_a_time(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 150))]
    patterns = packing.shortest_pack_first(Counter(lengths), capacity)
    # Which of equally full packs an item goes to is open; how full packs get is not.
    filled, items = Counter(), Counter()
    for packs, pattern in patterns:
        filled[sum(n * run for n, run in pattern)] += packs
        for n, run in pattern:
            items[n] += packs * run
    assert filled == Counter(map(sum, greedy(lengths, capacity))) and items == Counter(lengths)


def test_packing_places_every_token_once(spark, sf):
    rows = packing.pack(docs(spark, sf), capacity=512).collect()
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in docs(spark, sf).collect()}
    by_doc, packs = Counter(), {}
    for r in rows:
        by_doc[r["doc_id"]] += r["piece_tokens"]
        packs.setdefault(r["pack_id"], []).append((r["slot"], r["pack_offset"], r["piece_tokens"]))
    assert by_doc == Counter(words)
    assert set(packs) == set(range(len(packs)))
    for p in packs.values():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p)))
        assert [x[1] for x in p] == [sum(y[2] for y in p[:i]) for i in range(len(p))] and p[-1][1] + p[-1][2] <= 512


def test_placements_cover_each_rank_once():
    rng = random.Random(8)
    histogram = Counter(rng.randint(1, 64) for _ in range(3000))
    rows = packing.placements(packing.shortest_pack_first(histogram, 64))
    blocks = packing.in_blocks(rows, histogram)
    assert len(blocks) <= 2 * len(rows) + len(histogram)
    found = Counter()
    for size, (length, block, low, high, *_) in blocks:
        for rank in range(max(low, block * size), min(high, (block + 1) * size)):
            found[length, rank] += 1
    assert found == Counter({(n, r): 1 for n, k in histogram.items() for r in range(k)})


def test_packing_of_awkward_rows(spark):
    rows = packing.pack(awkward(spark), capacity=1000).collect()
    assert sorted(r["doc_id"] for r in rows if r["pack_id"] is None) == [1, 2, 3]
    assert Counter(r["doc_id"] for r in rows)[5] == 61 and Counter(r["doc_id"] for r in rows)[4] == 2
    assert packing.pack(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.shortest_pack_first({11: 1}, 10)


# sharding


def test_sharding_is_a_seeded_permutation(spark, sf, tmp_path):
    d = docs(spark, sf)
    a = sharding.write_shards(d, str(tmp_path / "a"), bucket_bytes=60_000)
    b = sharding.shuffled(d.repartition(7), bucket_bytes=60_000)
    key = lambda df: sorted((r["shard"], r["position"], r["doc_id"]) for r in df.collect())
    assert key(a) == key(b) != key(sharding.shuffled(d, bucket_bytes=60_000, seed=12))
    assert a.select(d.columns).exceptAll(d).isEmpty() and a.count() == d.count()
    shards = Counter(r["shard"] for r in a.collect())
    assert len(shards) > 4 and max(shards.values()) < 4 * d.count() / len(shards)
    assert len([f for f in a.inputFiles()]) == len(shards)


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, s, 0)) for s in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400
    assert sharding.fisher_yates(0, 1, 1).tolist() == [] and sharding.fisher_yates(1, 1, 1).tolist() == [0]


def test_repeated_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_COPIES", 20)
    monkeypatch.setattr(sharding, "BLOCK", 64)
    d = spark.createDataFrame([(i if i % 3 else 0, "x" * 50, {"a": i if i % 3 else 0}) for i in range(3000)], "doc_id long, text string, m map<string,int>")
    out = sharding.shuffled(d, bucket_bytes=12_000, most_hot=100)
    rows = out.collect()
    assert Counter((r["doc_id"], r["text"], r["m"]["a"]) for r in rows) == Counter((r["doc_id"], r["text"], r["m"]["a"]) for r in d.collect())
    copies, every = Counter(r["shard"] for r in rows if r["doc_id"] == 0), Counter(r["shard"] for r in rows)
    assert len(every) > 10 and max(copies.values()) < 3 * 1000 / len(every) and max(every.values()) < 2 * 3000 / len(every)
    again = sharding.shuffled(d.repartition(5), bucket_bytes=12_000, most_hot=100).collect()
    assert sorted((r["shard"], r["position"], r["doc_id"]) for r in rows) == sorted((r["shard"], r["position"], r["doc_id"]) for r in again)


def test_scatter_is_uniform(spark):
    out = sharding.shuffled(spark.range(20_000).withColumn("text", F.lit("y" * 92)), bucket_bytes=108 * 20_000 // 16)
    n = [r["count"] for r in out.groupBy("shard").count().collect()]
    expected = 20_000 / len(n)
    assert len(n) >= 16 and sum((x - expected) ** 2 / expected for x in n) < 2.5 * len(n)  # chi squared


def test_sharding_of_awkward_rows(spark):
    d = awkward(spark)
    out = sharding.shuffled(d, bucket_bytes=1000)
    assert out.count() == 9 and out.columns == [c for c in d.columns if c != "shard"] + ["shard", "position"]
    assert sharding.shuffled(empty(spark)).count() == 0


# language


def all_segmentations(word, p):
    if not word:
        return 1.0
    return sum(p[word[:n]] * all_segmentations(word[n:], p) for n in range(1, len(word) + 1) if word[:n] in p)


def tiny_model():
    rows = [("en", b"the cat and the dog sat there then"), ("fr", b"le chat et la chatte chantent la")]
    pieces = sorted({bytes([b]) for b in range(97, 123)} | {b" ", b" t", b"th", b" th", b"he", b"the", b" the", b"at", b"cat", b"cha", b"la", b" la", b" le", b"an", b"nd"})
    return langid.train(rows, pieces), pieces


def test_language_sums_all_segmentations():
    model, pieces = tiny_model()
    for word in (b"the", b"chat", b"thethe", b"and", b"q", b"thecat"):
        data = np.frombuffer(word, np.uint8)
        got = model.log_probabilities(data, np.array([0]), np.array([len(word)]))[0]
        want = [math.log(all_segmentations(b" " + word, dict(zip(pieces, model.p[:, k])))) for k in range(3)]
        assert np.allclose(got, want)


def test_language_scores_equal_brute_force():
    """Language, score, margin and evidence of whole texts, unit by unit, and EM's counts by all segmentations."""
    model, pieces = tiny_model()

    def paths(word):
        return [[word[:n], *rest] for n in range(1, len(word) + 1) if word[:n] in pieces for rest in (paths(word[n:]) if word[n:] else [[]])]

    texts = [b"the cat and", b"la chatte the", b"chat", b"a" * 70 + b" b"]
    for text, row in zip(texts, model.score(texts)):
        units = [u[i : i + langid.WORD] for u in text.split() for i in range(0, len(u), langid.WORD)]
        if len(text) > 20:
            assert row[4] == len(units)
            continue
        logs = np.array([[math.log(all_segmentations(b" " + u, dict(zip(pieces, model.p[:, k])))) for k in range(3)] for u in units])
        sums = np.log((1 - langid.NOISE) * np.exp(logs[:, :2]) + langid.NOISE * np.exp(logs[:, 2:])).sum(axis=0)
        best = int(np.argmax(sums))
        want = (model.languages[best], sums[best] / sum(len(u) + 1 for u in units), sums[best] - sums[1 - best], (sums[best] - logs[:, 2].sum()) / len(units), len(units))
        assert row[0] == want[0] and np.allclose(row[1:5], want[1:])
    q = dict(zip(pieces, (x := (1.0 / len(pieces)) ** np.minimum([len(p) for p in pieces], 3)) / x.sum()))
    expected = Counter()
    for word in b"the cat and the dog sat there then".split():
        each = [(math.prod(q[p] for p in path), path) for path in paths(b" " + word)]
        for weight, path in each:
            for p in path:
                expected[p] += weight / sum(w for w, _ in each)
    p = np.array([expected[x] + 0.5 / len(x) for x in pieces])
    one = langid.train([("en", b"the cat and the dog sat there then")], pieces, rounds=1)
    assert np.allclose(one.p[:, 0], p / p.sum())


def test_vocabulary_finds_exactly_its_pieces():
    pieces = langid.read_pieces(f"{langid.TOKENIZERS}/{langid.VOCABULARY}")
    v = langid.Vocabulary(pieces)
    keys = np.array([v.key(p) for p in pieces], np.uint64)
    rows, ids = v.find(keys)
    assert (rows == np.arange(len(pieces))).all() and (ids == rows).all()
    assert len(v.find(W.mixed(keys + np.uint64(1)))[0]) == 0


def test_language_is_right_on_unseen_documents(spark):
    d = docs(spark, "/root/testdata/sf0.01")
    model = langid.fit(d.where("doc_id % 2 = 0"), rows_each=100)
    rows = langid.identify(d.where("doc_id % 2 = 1"), model=model).join(d.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert sum(r["lang"] == r["truth"] for r in rows) / len(rows) > 0.98
    assert sum(r["accepted"] for r in rows) / len(rows) > 0.98
    key = spark.createDataFrame([(1, 'Est une avec token = "6cfd1f1f244d4c4c327ecfd8fd9898497c475388" pour les.')], "doc_id long, text string")
    assert langid.identify(key, model=model).first()["accepted"]
    odd = spark.createDataFrame([("a", "zqxj wvkq pfzx qqzj vxkw zzqx jqvz xkqz wqxz kzvj " * 20)], "doc_id string, text string")
    assert not langid.identify(odd, model=model).first()["accepted"]


FOREIGN = {
    "it": "La mattina presto il vecchio pescatore usciva di casa e camminava lungo la riva del mare per vedere se le barche erano tornate dal largo",
    "pt": "O menino correu pela rua e a sua vizinha viu o cachorro dormir ao sol perto da janela aberta da cozinha enquanto chovia na serra",
    "nl": "De oude man liep elke ochtend langs het water om te kijken of de schepen al terug waren van zee met vis voor de markt",
    "ru": "Старик каждое утро выходил из дома и шёл вдоль берега моря чтобы посмотреть вернулись ли лодки с уловом свежей рыбы для городского рынка",
    "ja": "老人は毎朝家を出て海岸沿いを歩き、船が新鮮な魚を積んで戻ってきたかどうかを見に行きました。町の市場はいつも賑やかでした。" * 6,
}


def test_other_languages_are_refused():
    """Foreign texts of some twenty words, and those of each language by models of the others."""
    import pyarrow.parquet as pq

    rows = [r for r in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "lang", "text"]).to_pylist() if r["text"]]
    some, rest = [], []
    n = Counter()
    for r in rows:
        n[r["lang"], r["doc_id"] % 2] += 1
        if n[r["lang"], r["doc_id"] % 2] <= 250:
            (some if r["doc_id"] % 2 else rest).append((r["lang"], r["text"].lower()))
    pieces = langid.read_pieces(f"{langid.TOKENIZERS}/{langid.VOCABULARY}")
    model = langid.train([(k, t.encode()) for k, t in some], pieces)
    assert not any(r[5] for r in model.score([t.lower().encode() for t in FOREIGN.values()]))
    own = model.score([t.encode() for _, t in rest])
    assert np.mean([r[5] for r in own]) > 0.99 and np.mean([r[0] == k for r, (k, _) in zip(own, rest)]) > 0.98
    for left in model.languages:
        other = langid.train([(k, t.encode()) for k, t in some if k != left], pieces)
        cut = [" ".join(t.split()[:25]).encode() for k, t in rest if k == left and len(t.split()) >= 25]
        assert np.mean([r[5] for r in other.score(cut)]) < 0.15  # some texts of a language have passages of another


def test_language_of_awkward_rows(spark):
    model = langid.fit(docs(spark, "/root/testdata/sf0.001"), rows_each=50)
    got = {r["doc_id"]: r for r in langid.identify(awkward(spark), model=model).collect()}
    assert [got[i]["lang"] for i in (1, 2, 3)] == [None] * 3 and not any(got[i]["accepted"] for i in (1, 2, 3))
    assert got[4]["lang"] == "en" and got[5]["words"] == 60_157
    assert langid.identify(empty(spark)).count() == 0
    none = docs(spark, "/root/testdata/sf0.001").withColumn("lang", F.lit(None).cast("string"))
    assert langid.accepted(none).count() == none.count()
    assert langid.accepted(awkward(spark)).columns == awkward(spark).columns


# chat


def slow_spans(turns, render):
    out = []
    for k in range(1, len(turns) + 1):
        a, b = render(turns[: k - 1]), render(turns[:k])
        if b[: len(a)] == a:
            out.append((len(a), len(b), False))
            continue
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        j = 0
        while j < min(len(a), len(b)) - i and a[len(a) - 1 - j] == b[len(b) - 1 - j]:
            j += 1
        out.append((i, len(b) - j, True))
    return out


@pytest.mark.parametrize("name", sorted(chat.TEMPLATES))
def test_chat_spans_equal_brute_force(spark, sf, name):
    render = chat.TEMPLATES[name]
    conversations = {-1: [("user", "end"), ("im", "<|im_end|>"), ("user", "user"), ("user", "<"), ("assistant", "im"), ("system", "s")]}
    table = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame([(-1, i, *t) for i, t in enumerate(conversations[-1])], "conv_id long, turn long, role string, text string"))
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        conversations.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = {}
    for r in chat.format_chats(table, {name: render}).orderBy("turn").collect():
        got.setdefault(r["conv_id"], []).append(r)
    for conv, turns in conversations.items():
        want = slow_spans(turns, render)
        assert [(r["start"], r["stop"], r["rewrites"]) for r in got[conv]] == want
        for k, r in enumerate(got[conv]):
            if r["text_start"] is not None:
                assert render(turns[: k + 1])[r["text_start"] : r["text_stop"]] == turns[k][1]
            if name == "chatml" and turns[k][1]:
                assert r["text_start"] == r["start"] + len("<|im_start|>") + len(turns[k][0]) + 1


def test_rewriting_templates_are_found():
    turns = [("system", "be kind"), ("user", "hi"), ("assistant", "yo"), ("user", "more")]
    assert [s.rewrites for s in chat.spans(turns, chat.system_in_last_user)] == [False, False, False, True]
    assert not any(s.rewrites for s in chat.spans(turns, chat.chatml))


def test_places_of_texts():
    at = lambda turns, render=chat.chatml: chat.spans(turns, render)[-1][2:4]
    assert at([("user", "end")]) == (17, 20) and at([("user", "im")]) == (17, 19) and at([("user", "")]) == (None, None)
    assert at([("user", " a ")], lambda t: "".join(f"[{x.strip()}]" for _, x in t)) == (None, None)  # changed
    assert at([("user", "a")], lambda t: "".join(f"[{x}|{x}]" for _, x in t)) == (3, 4)  # twice: the last
    assert at([("u", "x"), ("u", "[")], lambda t: "[" * 3 + "".join(x for _, x in t)) == (4, 5)
    assert at([("user", chat.mark_for([]))]) == (17, 17 + len(chat.mark_for([])))


def test_templates_that_refuse(spark):
    def strict(turns):
        if not turns:
            raise ValueError("no turns")
        if any(r == "tool" for r, _ in turns[-1:]):
            raise KeyError("tool")
        return "".join(f"<{r}>{t}" for r, t in turns)

    got = chat.spans([("user", "a"), ("tool", "b"), ("user", "c")], strict)
    assert got[0][:5] == (0, 7, 6, 7, False) and got[1].start is None and "tool" in got[1].error
    assert got[2][:5] == (7, 21, 20, 21, False)
    df = spark.createDataFrame([("c1", 0, "user", "a"), ("c1", 1, "tool", "b")], "conv_id string, turn long, role string, text string")
    rows = chat.format_chats(df, {"strict": strict}).orderBy("turn").collect()
    assert [r["conv_id"] for r in rows] == ["c1", "c1"] and [r["error"] is None for r in rows] == [True, False]


def test_chat_of_awkward_rows(spark):
    rows = [(1, 0, None, "a", 1), (1, 0, "user", None, 2), (1, None, "user", "", 3), (None, 1, "user", "x" * 100_000, 4), (1, 0, "user", None, 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    out = chat.format_chats(df, {"chatml": chat.chatml}).collect()
    assert len(out) == 5 and [r["stop"] - r["start"] for r in out if r["conv_id"] is None] == [12 + 4 + 1 + 100_000 + 11]
    assert chat.format_chats(df.limit(0)).count() == 0


# toxicity


def test_toxicity_on_unseen_documents(spark):
    """Trained on half of the labels, held against the other half."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = docs(spark, sf).join(labels.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["text"])
    rows = toxicity.toxicity(d, labels.where("doc_id % 2 = 0")).where("doc_id % 2 = 1").join(labels.withColumnRenamed("toxic", "truth"), "doc_id").collect()
    bad, good = [r for r in rows if r["truth"]], [r for r in rows if not r["truth"]]
    assert sum(r["toxic"] for r in bad) / len(bad) > 0.5
    assert sum(r["toxic"] for r in good) / len(good) < 0.02


def labelled_english():
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.1"
    toxic = {}
    for r in pq.read_table(f"{sf}/labels.parquet", columns=["doc_id", "toxic"]).to_pylist():
        toxic[r["doc_id"]] = max(toxic.get(r["doc_id"], 0), r["toxic"] or 0)
    rows = [r for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "lang", "text"]).to_pylist() if r["lang"] == "en" and r["doc_id"] in toxic and r["text"]]
    return [[[r["text"] for r in rows if r["doc_id"] % 2 == odd and toxic[r["doc_id"]] == bad] for bad in (0, 1)] for odd in (0, 1)]


def test_toxic_passages_in_long_texts_are_found():
    (ordinary, bad), (others, worse) = labelled_english()
    model = toxicity.train(ordinary, bad)
    pairs = [toxicity.compressors(v) for v in model.votes]
    found = lambda text: toxicity.score(text, model, pairs)[1] > 1
    rng = random.Random(2)
    long = [" ".join(rng.sample(others, 10)) for _ in range(60)]
    alone = [t for t in worse if 100 <= len(t.split()) <= 300 and found(t)][:60]
    assert len(alone) > 20 and sum(map(found, long)) <= 6
    hits = [found(x[: len(x) // 2] + " " + t + " " + x[len(x) // 2 :]) for x, t in zip(itertools.cycle(long), alone)]
    assert sum(hits) / len(alone) > 0.8


def test_toxic_words_may_occur_in_ordinary_texts():
    (ordinary, bad), (others, worse) = labelled_english()
    rng, known = random.Random(1), {w for t in ordinary for w in t.lower().split()}
    spread = Counter(w for t in bad for w in set(t.lower().split()) if w not in known)
    for w in sorted(w for w, n in spread.items() if n >= 2):
        for i in rng.sample(range(len(ordinary)), 3):
            ordinary[i] += " " + w
    model = toxicity.train(ordinary, bad)
    pairs = [toxicity.compressors(v) for v in model.votes]
    found = [[toxicity.score(t, model, pairs)[1] > 1 for t in texts] for texts in (worse, others)]
    assert np.mean(found[0]) > 0.8 and np.mean(found[1]) < 0.01


def test_windows_cover_the_text():
    for text in ("", "a", "some words of a text " * 50, "x" * 1000, "é" * 300):
        assert b"".join(toxicity.windows(text, 64)) == text.lower().encode()


def test_gains_equal_single_compressions():
    a, b = b"the cat and the dog " * 20, b"you horrible moron " * 20
    v = toxicity.Vote(a, b, 32)
    text = "you horrible moron and the cat"
    import zstandard

    def size(data, w):
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(w))

    want = [size(a, w) - size(b, w) for w in toxicity.windows(text, 32)]
    assert toxicity.gains(text, toxicity.compressors(v), 32).tolist() == want and max(want) > 0
    assert toxicity.counting(text, toxicity.compressors(v), v._replace(least=3)).tolist() == [x if x >= 3 else 0 for x in want]


@pytest.mark.parametrize("seed", range(5))
def test_thresholds_equal_counts(seed):
    rng = random.Random(seed)
    found = [np.array([rng.randint(-4, 6) for _ in range(rng.randint(0, 60))], np.int64) for _ in range(12)]
    flat = [x for g in found for x in g.tolist()]
    t = toxicity.threshold(found, 0.2)
    share = lambda c: sum(x >= c for x in flat) / len(flat)
    assert share(t) <= 0.2 and all(share(x) > 0.2 for x in flat if x < t)
    assert toxicity.threshold([]) == 1


def slow_judge(text, m):
    """All windows and runs once more, one by one."""
    import zstandard

    def size(data, w):
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=toxicity.LEVEL)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(w))

    saved = [[size(v.ordinary, w) - size(v.toxic, w) for w in toxicity.windows(text, v.window)] for v in m.votes]
    hits = [[float(g) if g >= v.least else 0.0 for g in each] for each, v in zip(saved, m.votes)]
    n = len(hits[0])
    if not n:
        return 0.0
    deviation = lambda h, v, k: (sum(h) - len(h) * v.mean) / (v.sd * math.sqrt(k + toxicity.PRIOR))
    scores = [np.mean([deviation(h, v, len(h)) for h, v in zip(hits, m.votes)]) / m.cut]
    for run, cut in m.runs.items():
        if n > run:
            each = []
            for h, v in zip(hits, m.votes):
                k = min(len(h), max(1, round(run * m.votes[0].window / v.window)))
                each.append(max(deviation(h[i : i + k], v, k) for i in range(len(h) - k + 1)))
            scores.append(np.mean(each) / max(toxicity.LEAST_CUT, cut.at + cut.slope * math.log(n / cut.windows)))
    return max(scores)


def test_toxicity_equals_brute_force(spark):
    """The whole operator on a small table against :func:`slow_judge`; ids are strings, other names."""
    (ordinary, bad), (others, worse) = labelled_english()
    texts = others[:25] + worse[:15] + ["", " ".join(others[:3]) + " " + worse[0]]
    rows = [(f"t{i}", t) for i, t in enumerate(texts)] + [(f"o{i}", t) for i, t in enumerate(ordinary[:260])] + [(f"b{i}", t) for i, t in enumerate(bad[:60])]
    labels = spark.createDataFrame([(i, int(i[0] == "b")) for i, _ in rows if i[0] != "t"], "key string, toxic int")
    df = spark.createDataFrame(rows, "key string, body string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, labels, id_col="key", text_col="body").collect()}
    m = toxicity.train_models([(None, t, int(i[0] == "b")) for i, t in rows if i[0] != "t"])[toxicity.POOLED]
    for i, t in rows[: len(texts)]:
        assert got[i]["score"] == pytest.approx(slow_judge(t, m)) and got[i]["toxic"] == (got[i]["score"] > 1), i


def test_toxicity_of_awkward_rows(spark, sf):
    labels = spark.createDataFrame([(4, 0, 1), (None, 1, 1), (7, None, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(awkward(spark), labels).collect()
    assert len(rows) == 9 and not any(r["toxic"] for r in rows if not r["windows"])
    assert toxicity.toxicity(awkward(spark), labels.limit(0)).where("toxic").count() == 0
    assert toxicity.toxicity(empty(spark), labels).count() == 0


# html


def test_html_extraction():
    page = "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><ul>" + "<li><a href='/x'>link</a></li>" * 12 + "</ul><article>" + "".join(f"<p>Paragraph {i} has a good number of words, &amp; says <b>something</b> about it.</p>" for i in range(8)) + "</article><footer><a>x</a> <a>y</a></footer></body></html>"
    text, lines, kept = html.extract_text(page)
    assert text.count("Paragraph") == 8 and "link" not in text and "& says something" in text and "var" not in text and "T" != text[:1]
    assert (lines, kept) == (len(html.lines_of(page)), text.count("\n") + 1)


@pytest.mark.parametrize("start", ["<html><head><title>x</title>", "<head><meta charset=a><noscript><img></noscript>", "<body><noscript>", "<body><template>", "<body><svg><g>", "<svg><svg></svg>", "<head><noscript>"])
def test_open_hidden_elements_do_not_hide_the_page(start):
    assert "the text" in [t for t, _ in html.lines_of(start + "<p>the text<div>more</div>")]
    assert [t for t, _ in html.lines_of("<svg><p>a</p></svg><head><title>b</title></head><p>c") if t] == ["c"]
    assert [t for t, _ in html.lines_of("<head><title>b</title>some text") if t] == ["some text"]


def slow_extract(page, radius=2, sigma=1.0):
    """Lines, ratios, smoothing and the choice of lines once more, number by number."""
    lines = html.lines_of(page)
    if not lines:
        return "", 0, 0
    logs = [math.log(1 + len(t) / (n if n > 0 else 1)) for t, n in lines]
    smooth = []
    for i in range(len(logs)):
        near = [(math.exp(-((j - i) ** 2) / (2 * sigma * sigma)), logs[j]) for j in range(len(logs)) if abs(i - j) <= radius]
        smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    cut = (min(smooth) + max(smooth)) / 2
    for _ in range(100):
        high, low = [x for x in smooth if x > cut], [x for x in smooth if x <= cut]
        if not high or not low:
            break
        new = (sum(high) / len(high) + sum(low) / len(low)) / 2
        if abs(new - cut) <= 1e-9 * max(abs(new), abs(cut)):
            break
        cut = new
    kept = [t for (t, _), x in zip(lines, smooth) if t and (x > cut or abs(x - cut) < 1e-9)]
    return "\n".join(kept), len(lines), len(kept)


def test_html_text_equals_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("page_id", F.concat(F.lit("p"), "page_id")).withColumn("text", F.lit(1))
    want = {r["page_id"]: slow_extract(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: (r["text"], r["lines"], r["kept"]) for r in html.extract(pages).collect()}
    assert got == want and any(k for _, _, k in got.values())


def test_html_chunks_do_not_matter(monkeypatch, spark, sf):
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").limit(20).collect()]
    whole = [html.extract_text(p) for p in pages]
    monkeypatch.setattr(html, "CHUNK", 7)
    assert [html.extract_text(p) for p in pages] == whole


def test_smoothing_equals_sums():
    x = np.random.default_rng(1).random(15)
    want = []
    for i in range(15):
        w = {j: math.exp(-((j - i) ** 2) / 2) for j in range(15) if abs(j - i) <= 2}
        want.append(sum(x[j] * v for j, v in w.items()) / sum(w.values()))
    assert np.allclose(html.smoothed(x, 2, 1.0), want)
    for n in (1, 2, 3, 4):
        assert len(html.smoothed(x[:n], 2, 1.0)) == n
    assert html.two_means(np.array([1.0, 1.1, 5.0, 5.2])) == pytest.approx(3.075)


def test_html_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "<p>unclosed <b>text"), (4, "plain < text & more"), (None, "<p>a</p>"), (4, "<!--" + "x" * 100_000), (5, "<p>" + "w " * 100_000)]
    out = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert out[1]["text"] == out[2]["text"] == "" and out[3]["text"] == "unclosed text" and len(out[5]["text"]) == 199_999
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


# near-duplicates


def weights_of(texts):
    sets = neardup.shingles([t.encode() for t in texts])
    df = np.zeros(1 << neardup.DF_BITS)
    for s in sets:
        np.add.at(df, np.unique(neardup.cells(neardup.counted(s)[0])), 1)
    return neardup.Weights(df, sum(len(s) > 0 for s in sets)), sets


def brute_groups(rows, threshold):
    w, sets = weights_of([t for _, t in rows])
    levels = [w.levels(s) for s in sets]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = 0
    for (i, a), (j, b) in itertools.combinations(zip([i for i, _ in rows], levels), 2):
        if neardup.weighted_jaccard(a, b) >= threshold:
            pairs += 1
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    groups = {i: find(i) for i, _ in rows}
    sizes = Counter(groups.values())
    return {i: g for i, g in groups.items() if sizes[g] > 1}, pairs


def test_near_duplicates_equal_brute_force(spark):
    d = docs(spark, "/root/testdata/sf0.01").where("doc_id < 600")
    rows = sorted((r["doc_id"], r["text"].lower()) for r in d.collect())
    want, _ = brute_groups(rows, neardup.THRESHOLD)
    got = {r["doc_id"]: r["group_id"] for r in neardup.near_duplicates(d).collect()}
    assert len(want) > 40
    assert sum(got.get(k) == v for k, v in want.items()) / len(want) >= 0.95 and not set(got) - set(want)
    kept = {r["doc_id"] for r in neardup.without_copies(d).collect()}
    assert kept == {i for i, _ in rows} - {i for i, g in got.items() if i != g}


def banded_groups(rows, threshold):
    """Groups by all pairs that share a band; how many pairs are similar, and how many of these share one."""
    weights, sets = weights_of([r["text"].lower() for r in rows])
    levels = [weights.levels(x) for x in sets]
    sampler = neardup.Sampler()
    keys = [set(sampler.bands(*x).tolist()) if len(x[0]) else set() for x in levels]
    ids = [r["doc_id"] for r in rows]
    group = {i: i for i in ids}
    close = shared = 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i]["family"] == rows[j]["family"] and neardup.weighted_jaccard(levels[i], levels[j]) >= threshold:
            close += 1
            if keys[i] & keys[j]:
                shared += 1
                a, b = group[ids[i]], group[ids[j]]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    return {k: g for k, g in group.items() if sum(x == g for x in group.values()) > 1}, close, shared


def revisions(families, size, changed, words=60):
    """Families of texts, each a revision of the one before it, in no order of ids."""
    rng = random.Random(3)
    rows, ids = [], rng.sample(range(10 * families * size), families * size)
    for f in range(families):
        text = [f"w{rng.randrange(10**9)}" for _ in range(words)]
        for _ in range(size):
            rows.append({"doc_id": ids[len(rows)], "text": " ".join(text), "family": f})
            text = list(text)
            at = rng.randrange(words)
            for k in range(changed):
                text[(at + k) % words] = f"w{rng.randrange(10**9)}"
    return rows


@pytest.mark.parametrize("open_pairs", [4, 0])
def test_near_duplicates_connect_all_that_share_a_band(spark, monkeypatch, open_pairs):
    monkeypatch.setattr(neardup, "OPEN_PAIRS", open_pairs, raising=False)
    rows = revisions(60, 8, 12)
    want, _, _ = banded_groups(rows, neardup.THRESHOLD)
    d = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    assert {r["doc_id"]: r["group_id"] for r in neardup.near_duplicates(d).collect()} == want


def boilerplate(n, seed=5):
    """Texts of which each has 60 of its 110 words in common with all, and some are alike."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(n):
        own = [f"w{rng.randrange(10**9)}" for _ in range(50)]
        if i % 5 == 4:  # as the one before, but for some words
            own = [w if rng.random() < 0.85 else f"v{rng.randrange(10**9)}" for w in rows[-1]["own"]]
        rows.append({"doc_id": i * 7 % 1009, "text": " ".join(common + own), "family": 0, "own": own})
    return rows


@pytest.mark.parametrize("block", [200, 8])
def test_hot_bands_are_decided_without_all_pairs(spark, monkeypatch, block):
    """Documents that share bands by what all have: the similar ones among them are found by rare shingles."""
    monkeypatch.setattr(neardup, "OPEN_PAIRS", 0)
    monkeypatch.setattr(neardup, "BLOCK_DOCS", block)
    monkeypatch.setattr(neardup, "SAMPLED", 1)
    monkeypatch.setattr(neardup, "HOT_SAMPLED", 4)
    called = []
    real = neardup.by_prefix
    monkeypatch.setattr(neardup, "by_prefix", lambda *a: called.append(1) or real(*a))
    monkeypatch.setattr(neardup, "_pairs", None)
    rows = boilerplate(160)
    want, close, _ = banded_groups(rows, neardup.THRESHOLD)
    d = spark.createDataFrame([(str(r["doc_id"]), r["text"]) for r in rows], "doc_id string, text string")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(d).collect()}
    assert called and close >= 20
    by_text = lambda groups: sorted(sorted(int(k) for k in groups if groups[k] == g) for g in set(groups.values()))
    found = by_text({k: r["group_id"] for k, r in got.items()})
    assert all(any(set(w) <= set(f) for f in found) for w in by_text(want)) and all(r["links"] > 0 for r in got.values())
    exact, _ = brute_groups([(r["doc_id"], r["text"]) for r in rows], neardup.THRESHOLD)
    assert all(any(set(f) <= set(w) for w in by_text(exact)) for f in found)


@pytest.mark.parametrize("seed", range(6))
def test_similar_sets_share_a_rare_shingle(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("a b c d e f g h i j k l m n o p".split()) for _ in range(rng.randint(2, 40))) for _ in range(40)]
    weights, sets = weights_of(texts)
    levels = [weights.levels(x) for x in sets]
    rare = [set(neardup.prefix(x, weights.log_idf[neardup.cells(x[0])], 0.4).tolist()) for x in levels]
    close = [(i, j) for i, j in itertools.combinations(range(40), 2) if neardup.weighted_jaccard(levels[i], levels[j]) >= 0.4]
    assert all(rare[i] & rare[j] for i, j in close) and sum(map(len, rare)) < sum(len(x[0]) for x in levels)


def test_repeated_ids_have_their_greatest_text(spark):
    text = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, text), (2, "zz " + text), (2, "aa"), (3, "aa bb cc dd")], "doc_id long, text string")
    assert {r["doc_id"]: (r["group_id"], r["links"]) for r in neardup.near_duplicates(d).collect()} == {1: (1, 1), 2: (1, 1)}


def test_pairs_close_to_the_threshold_share_a_band():
    rows = revisions(300, 4, 17)
    weights, sets = weights_of([r["text"] for r in rows])
    levels, sampler = [weights.levels(x) for x in sets], neardup.Sampler()
    keys = [set(sampler.bands(*x).tolist()) for x in levels]
    pairs = [(i, i + 1) for i in range(len(rows) - 1) if rows[i]["family"] == rows[i + 1]["family"] and 0.5 <= neardup.weighted_jaccard(levels[i], levels[i + 1]) < 0.56]
    found = sum(bool(keys[i] & keys[j]) for i, j in pairs)
    assert len(pairs) > 400 and found / len(pairs) >= 0.9


def test_samples_agree_as_often_as_sets_are_similar():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocab) for _ in range(300)]
    texts = [" ".join(w if rng.random() > p else rng.choice(vocab) for w in base) for p in (0, 0.05, 0.1, 0.2, 0.4)]
    w, sets = weights_of(texts + [" ".join(rng.choice(vocab) for _ in range(300)) for _ in range(30)])
    s = neardup.Sampler(samples=4096)
    levels = [w.levels(x) for x in sets[:5]]
    drawn = [s.sample(*x) for x in levels]
    for i, j in itertools.combinations(range(5), 2):
        agree = np.mean((drawn[i][0] == drawn[j][0]) & (drawn[i][1] == drawn[j][1]))
        assert abs(agree - neardup.weighted_jaccard(levels[i], levels[j])) < 0.04


def test_shingles_do_not_depend_on_neighbours():
    texts = [b"a b c d", b"", b"one", b"a b, c-d", b"x" * 3000 + b" y"]
    alone = [neardup.shingles([t])[0].tolist() for t in texts]
    assert [x.tolist() for x in neardup.shingles(texts)] == alone and alone[0] == alone[3] and len(alone[0]) == 3 and len(alone[2]) == 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 9), (4, 9), (30, 31)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["doc_id"]: r["group_id"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 4, 30: 30, 31: 30} | {100 + i: 100 for i in range(41)}


def test_near_duplicates_of_awkward_rows(spark):
    d = awkward(spark)
    got = {r["doc_id"]: r["group_id"] for r in neardup.near_duplicates(d).collect()}
    assert got == {4: 4, 7: 4}
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in neardup.without_copies(d).collect())
    assert kept == [-1, 1, 2, 3, 4, 5, 6]
    assert neardup.near_duplicates(empty(spark)).count() == 0 and neardup.without_copies(empty(spark)).count() == 0


# quality


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    a, b = compare(spark, queries.QUERIES[name], queries.ORACLES[name], sf)
    assert a == b and a


def test_order_of_rules_changes_nothing(spark, sf):
    d = docs(spark, sf)
    orders = [list(quality.RULES), list(reversed(quality.RULES))]
    results = [sorted((r["doc_id"], r["k"]["keep"]) for r in quality.judged(d, "k", order=o).collect()) for o in orders]
    assert results[0] == results[1]
    plan = quality.plan_cascade(d)
    assert {r.name for r, _, _ in plan} == {r.name for r in quality.RULES} and all(cost > 0 for _, cost, _ in plan)
    assert plan[0][2] / plan[0][1] == max(share / cost for _, cost, share in plan)


@pytest.mark.parametrize("seed", range(10))
def test_next_rule_rejects_most_of_what_is_left(seed):
    rng = random.Random(seed)
    costs = [rng.random() + 0.01 for _ in range(4)]
    rows = [rng.randrange(16) for _ in range(50)]
    order = quality.by_rejection_per_cost(costs, Counter(rows))
    assert sorted(order) == [0, 1, 2, 3]
    left = rows
    for k, i in enumerate(order):
        merit = lambda j: sum(m >> j & 1 for m in left) / costs[j]  # noqa: B023, E731
        assert merit(i) == max(merit(j) for j in order[k:])
        left = [m for m in left if not m >> i & 1]


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("q"))
    kept = {r["doc_id"] for r in quality.keep_good(docs(spark, sf)).collect()}
    rows = labels.collect()
    good, bad = [r["doc_id"] for r in rows if r["q"]], [r["doc_id"] for r in rows if not r["q"]]
    assert sum(i in kept for i in good) / len(good) > 0.98 and sum(i in kept for i in bad) / len(bad) < 0.1


def test_quality_of_awkward_rows(spark):
    d = awkward(spark)
    assert sorted(r["doc_id"] or -1 for r in quality.keep_good(d).collect()) == [-1, 4, 4, 6, 7]
    assert quality.keep_good(d).columns == d.columns and quality.quality(d).count() == 9
    assert quality.quality(empty(spark)).count() == 0


# media


def test_archives_round_trip(spark, tmp_path):
    rows = [(f"m{i}", bytes([i % 256]) * (i * 37)) for i in range(200)] + [("dup", b"1"), ("dup", b"2"), ("null", None), (None, b"x")]
    df = spark.createDataFrame(rows, "member string, payload binary").repartition(3)
    folder = media.write_archives(df, F.col("member"), F.col("payload"), str(tmp_path / "z"))
    got = media.read_archives(spark, folder, partitionBytes=2000)
    assert got.rdd.getNumPartitions() > 3
    assert sorted((r["member"], bytes(r["payload"])) for r in got.collect()) == sorted((a, b) for a, b in rows if a and b is not None)
    import zipfile

    assert sum(len(zipfile.ZipFile(p).namelist()) for p in (tmp_path / "z").glob("*.zip")) == 202


def test_a_broken_member_fails_alone(spark, tmp_path):
    df = spark.createDataFrame([(f"m{i}", b"payload %d " % i * 50) for i in range(10)], "member string, payload binary").coalesce(1)
    media.write_archives(df, F.col("member"), F.col("payload"), str(tmp_path))
    path = next(tmp_path.glob("*.zip"))
    data = bytearray(path.read_bytes())
    with pa.OSFile(str(path)) as f:
        m = media.read_directory(f, len(data))[4]
    data[m.offset + 34] ^= 255
    path.write_bytes(bytes(data))
    rows = media.read_archives(spark, str(tmp_path), retries=2).collect()
    assert [r["member"] for r in rows if r["error"]] == ["m4"] and sum(r["payload"] is not None for r in rows) == 9


def test_a_broken_archive_is_one_row(spark, tmp_path):
    import zipfile

    for name in ("a", "b/a", "c"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("m", name.encode())
    path = tmp_path / "c.zip"
    path.write_bytes(path.read_bytes()[:-30])
    (tmp_path / "empty.zip").write_bytes(b"")
    rows = {r["archive"]: r for r in media.read_archives(spark, str(tmp_path), retries=1, partitionBytes=20).collect()}
    assert set(rows) == {"a.zip", "b/a.zip", "c.zip", "empty.zip"} and bytes(rows["b/a.zip"]["payload"]) == b"b/a" and rows["a.zip"]["error"] is None
    assert rows["c.zip"]["payload"] is None and rows["c.zip"]["error"] and rows["empty.zip"]["error"]


def test_payloads_over_their_stated_size_are_refused(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", b"0" * 1_000_000)
    with pa.OSFile(str(tmp_path / "a.zip")) as f:
        (m,) = media.read_directory(f, (tmp_path / "a.zip").stat().st_size)
        assert len(media.read_member(f, m)) == 1_000_000
        with pytest.raises(ValueError):
            media.read_member(f, m._replace(size=10))


def test_members_are_retried_from_their_offset(tmp_path, monkeypatch):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(4):
            z.writestr(f"m{i}", b"x" * (i + 1))
    reader = media.ArchiveReader({"path": str(tmp_path)})
    real, calls = media.read_member, Counter()

    def flaky(f, m):
        calls[m.name] += 1
        if m.name == "m2" and calls[m.name] < 3:
            raise OSError("gone")
        return real(f, m)

    monkeypatch.setattr(media, "read_member", flaky)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert calls == {"m0": 1, "m1": 1, "m2": 3, "m3": 1} and all(r["error"] is None for r in rows)


def test_media_of_awkward_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "<html>" + "x" * 300_000, 1), (None, "a", 1), (3, "b", 1)]
    out = media.page_media(spark.createDataFrame(rows, "page_id long, html string, member int")).collect()
    assert sorted((r["page_id"], r["size"], r["kind"]) for r in out) == [(2, 0, "empty"), (3, 1, "application/octet-stream"), (3, 300_006, "text/html")]
    assert media.page_media(spark.createDataFrame([], "page_id long, html string")).count() == 0


# mixing


def brute_cost(patterns, quotas, costs, parts):
    """Least cost over all ways to send whole tokens."""
    names = sorted(quotas)
    best = math.inf
    choices = []
    for members, tokens in patterns:
        most = tokens * len(costs) // parts
        usable = [m for m in members if m in quotas]
        choices.append([c for c in itertools.product(range(most + 1), repeat=len(usable)) if sum(c) <= most])
    for combo in itertools.product(*choices):
        sent, cost = Counter(), 0
        for (members, tokens), c in zip(patterns, combo):
            usable = [m for m in members if m in quotas]
            for m, x in zip(usable, c):
                sent[m] += x
            n = sum(c)
            for k, price in enumerate(costs):
                step = tokens * (k % parts + 1) // parts - tokens * (k % parts) // parts
                cost += min(n, step) * price
                n -= min(n, step)
        if all(sent[n] <= quotas[n] for n in names):
            best = min(best, cost + sum(mixing.SHORT * (quotas[n] - sent[n]) for n in names))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_flow_is_of_least_cost(seed):
    rng = random.Random(seed)
    patterns = [(("a",), rng.randint(1, 3)), (("a", "b"), rng.randint(1, 3)), (("b", "c"), rng.randint(1, 2))]
    quotas = {k: rng.randint(0, 5) for k in "abc"}
    costs = (0, 1, 4)
    sent, cost = mixing.route(patterns, quotas, costs, 1)
    assert cost == brute_cost(patterns, quotas, costs, 1)
    for n in quotas:
        assert sum(v for (_, m), v in sent.items() if m == n) <= quotas[n]


def test_rare_sources_are_repeated_until_quotas_are_met():
    patterns, quotas = [(("hot",), 10**9), (("hot", "rare"), 10**5), (("rare",), 3)], {"hot": 746_268_656, "rare": 3_731_343}
    sent, _ = mixing.route(patterns, quotas, limited=False)
    assert {q: sum(v for (_, m), v in sent.items() if m == q) for q in quotas} == quotas
    assert sent[2, "rare"] / 3 == pytest.approx(sent[1, "rare"] / 10**5, rel=0.1)  # drawn on alike


def test_mix_repeats_a_rare_source_often(spark):
    d = spark.createDataFrame([(i, "a b c d e f g h i j", "en" if i else "xx", None, 0) for i in range(2000)], DOCS)
    got = Counter()
    for r in mixing.mix(d, {"lang=en": 0.9, "lang=xx": 0.1}, budget=10_000).collect():
        got[r["source"]] += r["tokens"]
    assert got == {"lang=en": pytest.approx(9000, rel=0.1), "lang=xx": 1000}


def test_mix_meets_quotas(spark):
    d = docs(spark, "/root/testdata/sf0.01")
    targets = {"lang=en": 0.3, "lang=fr": 0.4, "source=src1": 0.2, "lang=xx": 5.0, "source=src2": 0.1}
    rows = mixing.mix(d, targets, budget=100_000).collect()
    got = Counter()
    for r in rows:
        got[r["source"]] += r["tokens"]
    for k, v in (("lang=en", 30_000), ("lang=fr", 40_000), ("source=src1", 20_000), ("source=src2", 10_000)):
        assert abs(got[k] - v) < 0.1 * v + 3000, k
    member = {r["doc_id"]: {f"lang={r['lang']}", f"source={r['source']}"} for r in d.collect()}
    assert all(r["source"] in member[r["doc_id"]] for r in rows)
    assert rows and sorted(map(str, rows)) == sorted(map(str, mixing.mix(d.repartition(5), targets, budget=100_000).collect()))


def test_mix_repeats_what_is_scarce(spark):
    d = docs(spark, "/root/testdata/sf0.01")
    uses = Counter(r["use"] for r in mixing.mix(d, {"lang=es": 1.0}, budget=110_000).collect())
    assert uses[2] > 0 and abs(uses[1] - 106) <= 3
    assert Counter(r["doc_id"] for r in mixing.mix(d, {"lang=es": 1.0}, budget=110_000, rows=True).collect()).most_common(1)[0][1] == 3


def test_mix_of_awkward_rows(spark):
    d = awkward(spark)
    out = mixing.mix(d, share=1.0, rows=True)
    assert out.columns == d.columns and not {r["doc_id"] for r in out.collect()} & {1, 2, 3}
    assert mixing.mix(empty(spark)).count() == 0


# the pipeline


def test_pipeline_equals_its_stages(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mixing", "packing"]
    d = docs(spark, sf)
    step, sizes = d, [d.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        new = stage(spark, step, sf)
        assert k == 4 or new.columns == d.columns
        if k < 2:
            assert new.exceptAll(step).isEmpty()
        step = queries.quality.materialize(new, "test")
        sizes.append(step.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > sizes[4]
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(step) == rows(corpus_pipeline.run(spark, sf))


def test_pipeline_of_awkward_rows(spark):
    import corpus_pipeline

    for start in (awkward(spark), empty(spark)):
        step = start
        for _, stage in corpus_pipeline.STAGES:
            step = queries.quality.materialize(stage(spark, step, ""), "test")
        assert start.isEmpty() == (step.count() == 0)


def test_html_keeps_articles_and_drops_the_rest():
    """Words of the generated pages' articles against what is extracted."""
    import html as entities
    import re

    import duckdb

    def words(s):
        return Counter(re.sub(r"<[^>]+>", " ", entities.unescape(re.sub(r"<[^>]+>", " ", s))).split())

    recall, precision = [], []
    for (page,) in duckdb.connect().execute("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)</article>", page, re.S)
        if article:
            want, got = words(article[1]), Counter(html.extract_text(page)[0].split())
            both = sum((want & got).values())
            recall.append(both / want.total())
            precision.append(both / max(1, got.total()))
    assert len(recall) > 100 and np.mean(recall) > 0.97 and np.mean(precision) > 0.92

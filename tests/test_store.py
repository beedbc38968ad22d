import pytest
from pyspark.sql import functions as F

from quarry.events import EventLog
from quarry.plans.params import UnknownIndex, WriteError
from quarry.sources.index import Strategy
from quarry.sources.store import Collection, delete_collection, list_collections
from quarry.streaming.oplog import State, consume, visible


@pytest.fixture
def store(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "c")
    c.create_index("i")
    return c


def test_insert_replace_update_delete(store):
    assert store.insert("i", [{"id": "1", "role": "user", "name": "ann"}, {"id": "2", "name": "bob", "at": {"x": 1}}]) == {"inserted": 2, "replaced": 0, "failed": 0}
    assert store.insert("i", [{"id": "2", "name": "bo", "at": {"x": 1}}, {"name": "no id"}]) == {"inserted": 1, "replaced": 1, "failed": 0}
    assert store.search({"term": "bob"})["count"] == 0 and store.search({"term": "bo"})["count"] == 1
    assert store.update("i", [{"id": "2", "at.x": 5, "name": None}, {"id": "9", "a": 1}]) == {"inserted": 0, "updated": 1, "failed": 0}
    assert store.batch_get(["i:2", "i:2", "i:7"]) == {"i:2": {"id": "2", "at": {"x": 5}}}
    assert store.delete("i", ["i:1", "2", "8"]) == 2 and store.count() == 1
    with pytest.raises(WriteError):
        store.batch_get([str(i) for i in range(1001)])
    with pytest.raises(UnknownIndex):
        store.insert("no", [])


def test_swap_reindex_and_expiry(store):
    store.insert("i", [{"id": "1", "text": "old", "e": "long value here"}])
    store.create_index("t", temporary_of="i")
    store.insert("t", [{"id": "1", "text": "new"}])
    assert store.search({"term": "old"})["count"] == 1
    told = []
    store.on_replaced = lambda a, b: told.append((a, b))
    store.replace_index("i", "t")
    assert store.search({"term": "new"})["count"] == 1 and store.list_indexes() == ["i"] and told == [("i", "t")]
    store.reindex("i", Strategy(longest=2))
    assert store.search({"term": "", "where": {"text": "new"}})["count"] == 0
    store.create_index("old", temporary_of="i")
    assert store.drop_expired(3600) == [] and store.drop_expired(-1) == ["old"]
    store.delete_index("i")
    assert store.list_indexes() == []


def test_small_things(store, spark, tmp_path):
    store.insert("i", [{"id": str(k), "name": f"n{k}"} for k in range(8)])
    store.insert_shelf("best", ["5", "3", "99", "1"])
    assert [d["id"] for d in store.shelf("best")] == ["5", "3", "1"]
    store.insert_pin_rule({"id": "r", "conditions": [{"pattern": "n", "anchoring": "is"}], "consequence": {"promote": [{"doc_id": "6", "position": 0}]}})
    assert store.search({"term": "n"})["hits"][0]["id"] == "i:6"
    store.delete_pin_rule("r")
    store.set_value("a.x", "1")
    assert store.values("a.") == {"a.x": "1"} and store.pin_rules() == []
    store.delete_value("a.x")
    store.delete_shelf("best")
    store.max_documents = 8
    with pytest.raises(WriteError):
        store.insert("i", [{"id": "new"}])
    assert list_collections(str(tmp_path)) == ["c"]
    delete_collection(str(tmp_path), "c")
    assert list_collections(str(tmp_path)) == []


def test_save_hook(store):
    store.before_save = lambda df, values, secrets: df.withColumn("body", F.regexp_replace("body", "secret", "***"))
    store.insert("i", [{"id": "1", "t": "secret"}])
    assert store.batch_get(["i:1"])["i:1"]["t"] == "***" and store.search({"term": "secret"})["count"] == 1  # the original is indexed
    store.update("i", [{"id": "1", "u": "secret too"}])
    assert store.batch_get(["i:1"])["i:1"]["u"] == "*** too" and store.search({"term": "too"})["count"] == 1
    store.before_save = lambda df, values, secrets: df.withColumn("id", F.lit("x"))
    with pytest.raises(WriteError):
        store.insert("i", [{"id": "2"}])
    store.before_save = lambda df, values, secrets: None
    assert store.insert("i", [{"id": "2"}])["inserted"] == 1


def test_segments_and_compaction(store, monkeypatch):
    from quarry.sources import store as module

    monkeypatch.setattr(module, "MAX_SEGMENTS", 3)
    for k in range(3):
        store.insert("i", [{"id": "a", "n": k, "t": f"word{k}"}, {"id": f"b{k}", "t": "other"}])
    segments = store.pointers["i"]["segments"]
    assert [s["docs"] for s in segments] == [2, 2, 2] and [s["gone"] for s in segments] == [0, 1, 1]
    files = {f for _, _, f in __import__("os").walk(f"{store.root}/data") for f in f}
    assert store.delete("i", ["b0"]) == 1  # one segment too many: written as one
    assert len(store.pointers["i"]["segments"]) == 1 and files
    assert [store.search({"term": t})["count"] for t in ("word0", "word1", "word2", "other")] == [0, 0, 1, 2]
    assert store.search({"term": "", "where": {"n": {"eq": 2}}})["count"] == 1 and store.count() == 3
    assert store.vacuum() == 4 and store.search({"term": "other"})["count"] == 2


def test_writers_do_not_lose_changes(store, spark):
    import threading

    from quarry.sources.store import Collection

    others = [Collection(spark, store.root.rsplit("/", 1)[0], "c") for _ in range(4)]
    threads = [threading.Thread(target=lambda c=c, k=k: [c.set_value(f"{k}.{j}", "v") for j in range(10)]) for k, c in enumerate(others)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(store.values()) == 40
    e = store._entry("i")
    store.insert("i", [{"id": "1"}])
    with pytest.raises(WriteError):  # computed from what isn't there any more
        store._finish("i", {**e, "segments": []}, [])


def test_a_search_reads_few_rows(store):
    store.insert("i", [{"id": f"d{k}", "n": k, "s": f"v{k % 7}", "w": k / 2, "at": f"2023-01-{1 + k % 28:02d}", "p": {"lat": k, "lon": 1}} for k in range(60)])
    from quarry.plans.search import _bodies
    from quarry.plans.where import compile_where

    index = store.index("i")
    for where, column in [({"n": {"gte": 5}}, "GreaterThanOrEqual(f"), ({"w": {"between": [1.5, 3]}}, "LessThanOrEqual(f"), ({"s": "v3"}, "EqualTo(f"), ({"at": {"gt": "2023-01-05"}}, "GreaterThanOrEqual(d"), ({"p": {"radius": {"coordinates": {"lat": 9, "lon": 1}, "value": 10, "unit": "km"}}}, ".lat,")]:
        plan = index.docs.where(compile_where(index, where)).select("ord")._jdf.queryExecution().toString()
        pushed = plan[plan.index("PushedFilters") :].split("]")[0]
        assert column in pushed, (where, pushed)
    assert "In(ord, [1,2])" in _bodies(index).where(F.col("ord").isin([1, 2]))._jdf.queryExecution().toString()
    assert "In(id, [d1,d2])" in store.get_rows(["i:d1", "i:d2"])._jdf.queryExecution().toString()
    assert store.search({"term": "", "where": {"not": {"s": "v3"}}})["count"] == 51


def test_stems_languages_and_vectors(spark, tmp_path):
    from quarry.catalogue import letters
    from quarry.plans.search import Context

    c = Collection(spark, str(tmp_path), "v", Context(encoder=lambda t: letters()([t])[0]), make_encoder=letters)
    c.create_index("en")
    c.create_index("fr", language="french", embedding="none")
    c.insert("en", [{"id": "1", "t": "many studies"}, {"id": "2", "t": "zzz"}])
    c.insert("fr", [{"id": "1", "t": "les chevaux"}])
    assert c.search({"term": "study"})["count"] == 1 and c.search({"term": "study", "exact": True})["count"] == 0
    assert c.search({"term": "cheval"})["count"] == 1 and c.search({"term": "chevals", "tolerance": 0})["count"] == 1
    r = c.search({"term": "zz", "mode": "vector"})
    assert [h["id"] for h in r["hits"]] == ["en:2"] and c.search({"term": "zzz", "mode": "hybrid"})["hits"][0]["score"] == pytest.approx(1.0 + 1.0 / max(1.0, r["hits"][0]["score"]), abs=1.1)
    c.update("en", [{"id": "2", "t": "aaa"}])
    assert c.search({"term": "zz", "mode": "vector"})["count"] == 0 and c.search({"term": "a", "mode": "vector"})["count"] == 1
    with pytest.raises(WriteError):
        c.create_index("x", embedding="some")


def test_workers_get_the_source(tmp_path):
    """A job that starts in another folder, with the package on the driver's path alone."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / 'k')!r}).getOrCreate()
s.sparkContext.setLogLevel("OFF")
from quarry.sources.store import Collection
c = Collection(s, {str(tmp_path)!r}, "c"); c.create_index("i")
c.insert("i", [{{"id": "1", "t": "red"}}]); c.update("i", [{{"id": "1", "t": "blue"}}])
print("found", c.search({{"term": "blue"}})["count"])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "found 1" in done.stdout, done.stderr[-2000:]


def test_stats(store):
    store.insert("i", [{"id": "1", "n": 3, "b": True, "s": "x y"}, {"id": "2", "n": 5, "b": False}])
    rows = {(r["field"], r["kind"]): r for r in store.stats("i").collect()}
    assert (rows["n", "number"]["low"], rows["n", "number"]["high"]) == (3, 5) and rows["b", "bool"]["n_true"] == 1
    assert rows["s", "text"]["keys"] == 2 and rows["s", "text"]["average_length"] == 2
    assert store.filterable_fields("i").where("kind = 'text'").isEmpty()


def test_written_postings_give_the_same(spark, sf, tmp_path):
    from quarry.catalogue import documents
    from quarry.operators.text_score import text_scores
    from quarry.plans.params import Request

    index = documents(spark, sf)
    written = index.write(str(tmp_path / "p"))
    rows = lambda i: [(r["ord"], round(r["score"], 6)) for r in text_scores(i, Request("the clown")).orderBy("ord").collect()]
    assert rows(index) == rows(written) and rows(index)
    assert "StringStartsWith(term,clow)" in text_scores(written, Request("clow"))._jdf.queryExecution().toString()


def test_stream_is_exactly_once(spark, tmp_path):
    ops = [(1, "a", "x"), (2, "b", "y"), (3, "a", "z")]
    for k, part in enumerate((ops[:2], ops[2:], ops[1:])):  # the last repeats offsets
        spark.createDataFrame(part, "at long, id string, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        state = State(spark, str(tmp_path / "s"), "id", "at")
        stream = spark.readStream.schema("at long, id string, v string").parquet(str(tmp_path / "in"))
        consume(stream, state, str(tmp_path / "ck")).awaitTermination()
        v = state.version()
        state.apply(spark.createDataFrame([(99, "a", "late")], "at long, id string, v string"), v)  # a batch again
        assert state.version() == v
    assert sorted((r["id"], r["v"]) for r in state.read().collect()) == [("a", "z"), ("b", "y")]
    delta = spark.createDataFrame([(9, "a", "q", True)], "at long, id string, v string, gone boolean")
    assert [r["id"] for r in visible(state.read(), delta, "id", "at", "gone").collect()] == ["b"]


def test_transcripts(spark, store, tmp_path):
    from quarry.sources.transcripts import transcripts

    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('[{"id": "1", "a": {"b": {"c": "deep"}}, "n": null}, 5]')
    (tmp_path / "j" / "b.json").write_text('{"id": "2", "at": {"lat": 1, "lon": 2}}')
    (tmp_path / "j" / "c.json").write_text("{broken")
    rows = transcripts(spark, str(tmp_path / "j")).collect()
    assert sorted((r["body"], r["fits"]) for r in rows) == [('5', False), ('{"id": "1", "a.b.c": "deep"}', True), ('{"id": "2", "at": {"lat": 1, "lon": 2}}', True), ("{broken", False)]
    assert store.insert("i", transcripts(spark, str(tmp_path / "j")).select("body"))["failed"] == 2
    assert store.search({"term": "deep"})["count"] == 1


def test_streams_start_again():
    from quarry.streaming.oplog import consume_again

    class Query:
        def __init__(self, bad):
            self.bad = bad

        def awaitTermination(self):
            if self.bad:
                raise OSError("gone")

    started, waits = [], []
    consume_again(lambda: started.append(1) or Query(len(started) < 3), sleep=waits.append)
    assert len(started) == 3 and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        consume_again(lambda: Query(True), attempts=2, sleep=waits.append)


def test_event_log(spark, tmp_path):
    log = EventLog(str(tmp_path / "e"))
    assert log.read(spark).count() == 0
    log.append({"term": "a", "count": 2, "has_filters": True})
    assert log.read(spark).first()["term"] == "a"
    assert len(list(log.drain())) == 1 and list(log.drain()) == []

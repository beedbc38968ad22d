"""Work that must not grow beyond the input: what shuffles, and that results stay the same."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry import catalogue
from quarry.functions.embedding import embed
from quarry.functions.text import ENGLISH, LIGHT, STEM_CUT, STEM_TAIL, chunks, stem
from quarry.operators.stats import field_stats
from quarry.operators.text_score import text_scores
from quarry.plans.params import Request
from quarry.sources import store
from quarry.sources.index import from_table, infer_schema
from quarry.sources.store import Collection

WORDS = "studies study studying stopped stop boxes churches dishes passes houses häuser kindern chevaux beautés luces chicos chiodi laghi ações pães heden mogelijkheden flickorna äpplet ring rings bus 3d ẞ"


def grouped_by(df):
    """The keys of a plan's aggregates."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Aggregate \[([^\[\]]*)\], \[", plan)]


@pytest.mark.parametrize("request_", [Request("the clown", exact=True), Request("idiots"), Request("idiot", tolerance=1), Request("clown", tolerance=0)])
def test_a_search_groups_no_words_that_it_does_not_ask_for(spark, sf, request_):
    keys = grouped_by(text_scores(catalogue.documents(spark, sf), request_))
    assert keys and set(keys) <= {"ord"}


def test_vocabulary_is_counted_without_grouping_by_document(spark, sf):
    index = catalogue.documents(spark, sf)
    assert not any("ord" in k for k in grouped_by(index.vocabulary()) + grouped_by(field_stats(index).where("kind = 'text'")))


def test_vocabulary_of_repeated_ids_counts_documents_once(spark):
    df = spark.createDataFrame([(1, "a a b"), (1, "a c"), (2, "a"), (3, None), (4, " - ")], "k long, t string")
    assert sorted(map(tuple, from_table("i", df, "k").vocabulary().select("term", "df", "n").collect())) == [("a", 2, 4), ("b", 1, 1), ("c", 1, 1)]


def test_what_is_asked_of_words_first_holds_for_every_stem():
    for language in [ENGLISH, *LIGHT]:
        ends = [e for e, _ in LIGHT.get(language, ())]
        for word in [*WORDS.lower().split(), *("abcd" + e for e in ends), *("runn" + e for e in ("ing", "ed", "s", "ies", "sses"))]:
            s = stem(word, language)
            assert word.startswith(s[:-STEM_TAIL]) and 0 <= len(word) - len(s) <= STEM_CUT


def test_words_chosen_as_they_are_read_are_those_of_written_postings(spark, tmp_path):
    words = WORDS.split()[:12]
    df = spark.createDataFrame([(i, " ".join(words[i:] + words[: i % 3])) for i in range(len(words))], "k long, t string")
    index = from_table("i", df, "k")
    written = index.write(str(tmp_path / "written"))
    rows = lambda i, r: sorted((x["ord"], round(x["score"], 9)) for x in text_scores(i, r).collect())
    for request in [Request("study box", tolerance=0), Request("studi stop"), Request("studi", tolerance=1)]:
        assert rows(index, request) == rows(written, request) != []


def test_added_documents_replace_no_part_of_their_number(spark, sf, tmp_path):
    """Tables of over a million parts have the numbers that are added."""
    part = spark.read.parquet(f"{sf}/part.parquet").where("p_partkey < 30")
    part.unionByName(part.withColumn("p_partkey", part.p_partkey + 1_000_000)).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    ours = catalogue.collection_changes(spark, str(tmp_path)).select("p_partkey", "name", "brand", "size").collect()
    want = con.execute(f"select p_partkey, name, brand, size from ({catalogue.ORACLES['collection_changes']})").fetchall()
    assert sorted(map(str, map(tuple, ours))) == sorted(map(str, want))


def test_a_search_for_all_vectors_has_no_limit_and_no_order(spark, sf):
    plan = catalogue.collection_vectors(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort" not in plan


def test_a_word_of_all_documents_is_no_one_tasks(spark, tmp_path):
    index = from_table("i", spark.range(400).selectExpr("id k", "'same' t"), "k")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.write(str(tmp_path / "w"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "w" / "postings").glob("*.parquet"))) > 1 and not (tmp_path / "w" / "terms").exists()
    assert spark.read.parquet(str(tmp_path / "w" / "postings")).count() == 400


def test_texts_are_split_once_for_all_windows(spark):
    df = spark.createDataFrame([("a b c d e f g",), ("",), (None,)], "t string").repartition(1)
    out = df.select("t", chunks(F.col("t"), 3, 0.34).alias("w"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert {r["t"]: r["w"] for r in out.collect()} == {"a b c d e f g": ["a b c", "c d e", "e f g"], "": [""], None: [None]}


@pytest.mark.parametrize("keys", [range(12), [k // 2 for k in range(12)]], ids=["one row each", "repeated"])
def test_written_terms_are_those_of_grouped_words(spark, tmp_path, keys):
    words = WORDS.split()
    rows = [(k, " ".join(words[i:] + words[: i % 3] + words[i : i + 2]), [words[i], None, "Studies study rings"] if i % 4 else None) for i, k in enumerate(keys)]
    df = spark.createDataFrame([*rows, (99, " - ", []), (100, None, [None])], "k long, t string, a array<string>")
    for language in (ENGLISH, "french"):
        index = from_table("i", df, "k", language=language)
        written = index.write(str(tmp_path / language))
        own = lambda t, by: sorted(map(tuple, t.select(*by).collect()))
        by = ["field", "ord", "term", "tf", "len", "stemmed"][: 6 if len(set(keys)) == len(rows) else 4]
        assert own(index.postings, by) == own(written.postings, by) != []
        assert own(index.lengths, ["field", "ord", "len"]) == own(written.lengths, ["field", "ord", "len"])
        assert ("a", 1 if len(set(keys)) == len(rows) else 0, 4) in own(written.lengths, ["field", "ord", "len"])


def test_documents_of_one_shape_are_told_apart_where_it_does_not_decide(spark):
    docs = ['{"a": [{"b": 1}, 2], "d": "2023-01-05", "n": 1.5}', '{"a": [3, "x"], "d": "no date", "n": 12.25}', '{"a": ["y", 3], "e": [null]}', '{"e": [null, true]}']
    df = spark.createDataFrame(list(enumerate(docs)), "ord long, body string").repartition(2)
    assert infer_schema(df) == {"a": "number[]", "d": "date", "n": "number", "e": "bool[]"}


def test_an_insert_shuffles_a_body_once(spark, tmp_path, monkeypatch):
    """And sorts it before it gets columns, so that sampling for the ranges makes none."""
    plans = []
    make = store.typed
    monkeypatch.setattr(store, "typed", lambda docs, *a: plans.append((docs.columns, docs._jdf.queryExecution().optimizedPlan().toString())) or make(docs, *a))
    c = Collection(spark, str(tmp_path), "c")
    c.create_index("i")
    assert c.insert("i", [{"id": "1", "t": "x"}, {"id": "2"}]) == {"inserted": 2, "replaced": 0, "failed": 0}
    assert c.insert("i", [{"id": "1", "t": "y"}, {"id": "1", "t": "z"}]) == {"inserted": 0, "replaced": 1, "failed": 0}
    (columns, first), (_, second) = plans
    assert columns == ["ord", "id", "body"] and "Sort [ord" in first and "Aggregate" not in first and "Aggregate" in second
    assert sorted((r["id"], r["body"]) for r in c.documents("i").collect()) == [("1", '{"id": "1", "t": "z"}'), ("2", '{"id": "2"}')]


def test_an_encoder_gets_small_batches_and_its_vectors_go_on_together(spark):
    import numpy as np

    df = spark.range(0, 300, 1, 2).selectExpr("id k", "repeat('ab ', int(id % 3)) t")
    sizes = lambda texts: [[float(len(t)), float(len(texts))] for t in texts]
    for encoder in (sizes, lambda texts: np.array(sizes(texts))):
        rows = embed(df, "k", F.col("t"), lambda encoder=encoder: encoder).collect()
        assert sorted((r["k"], r["embedding"][0]) for r in rows) == [(k, float(3 * (k % 3) - 1)) for k in range(300) if k % 3]
        assert max(r["embedding"][1] for r in rows) == 64

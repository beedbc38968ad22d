import json

import pytest

from quarry.functions import dates
from quarry.functions.documents import leaves, merge
from quarry.functions.text import fill_template, format_properties, humanize, stem
from quarry.language import constraints as c
from quarry.language import notation as n


def one(q):
    return [(x.op, x.value, x.upper, x.hint) for x in c.numeric_constraints(q)]


def test_numbers():
    assert one("shoes under $50") == [("lte", 50, None, "price")]
    assert one("rating at least 4.5") == [("gte", 4.5, None, "rating")]
    assert one("between 10 and 20 kg and over 5") == [("between", 10, 20, "weight")]
    assert one("$50-$150") == [("between", 50, 150, "price")]
    assert one("exactly 3") == [("eq", 3, None, None)]
    assert one("at most fifty euros, score over 1,250.5") == [("lte", 50, None, "price"), ("gte", 1250.5, None, "rating")]
    assert one("budget of 2k") == [("lte", 2000, None, "price")] and [x[:2] for x in one("no less than 7 and no  more than 9")] == [("gte", 7), ("lte", 9)]


def test_enums_and_booleans():
    assert c.enum_constraints("men's red shoes", {"color": ["Red", "Blue"], "gender": ["male", "female"]}) == [c.Enum("Red", "Red", "color"), c.Enum("men's", "male", "gender")]
    found = c.bool_constraints("unavailable things", ["in_stock"])
    assert [(b.text, b.value, b.field) for b in found] == [("available", True, "in_stock"), ("unavailable", False, "in_stock")]
    assert c.bool_constraints("in stock", []) == []


def test_match_inject_missing():
    got = c.extract("red shoes under $50 in stock", {"color": ["red"]}, ["in_stock"])
    fields = ["full_price", "rating"]
    assert c.match_numerics(got, fields)[0][0] == "full_price"
    assert len(c.missing({}, got, fields)) == 3
    where = c.inject({}, got, fields)
    assert where == {"full_price": {"lte": 50.0}, "color": "red", "in_stock": True} and c.missing(where, got, fields) == []
    assert len(c.missing({"not": {"color": "red"}}, got, fields)) == 3
    assert c.missing({"or": [{"color": "x"}, {"in_stock": True}]}, got, fields)[0].op == "lte"
    assert 'full_price <= 50 (from "under $50")' in c.describe(got, fields)
    assert c.shared_budget("shirt and shoes, budget of $500 for both") and not c.shared_budget("under $5")
    shares = c.split_budget("a shirt and shoes, at most $100 for both", ["price"], [1, 2])
    assert [(x.query_index, x.budget_cap, x.field) for x in shares] == [(0, 33.33, "price"), (1, 66.67, "price")] and c.split_budget("under $5", ["price"], [1]) == []


def test_table_agrees_with_python(spark):
    queries = ["under $50 or over 3", "between 10 and 20", "$5-$9 exactly 7", "nothing", None, "max 5 min 2 exactly 1.5", "at most fifty or 1.5k", "from $1,000 to $2k, from 1000 to 2000"]
    rows = c.numeric_table(spark.createDataFrame([(q,) for q in queries], "q string"), "q").collect()
    for q, r in zip(queries, rows):
        assert [(x["op"], x["value"], x["upper"]) for x in r["constraints"]] == [(x.op, x.value, x.upper) for x in c.numeric_constraints(q or "")]


def test_notation():
    assert n.parse("a, b@0.5:10+; !c@1:3") == [n.Component(("a", "b"), 0.5, 10, True), n.Component(("c",), 1.0, 3, exclude=True)]
    assert n.parse("  ") == [] and n.all_sources(n.parse("a@1:1;b@1:1")) == {"a", "b"}
    for bad in ("a", "@1:2", "a@1", "a@x:2", "a@1:y", ";", "a@1:-1"):
        with pytest.raises(n.NotationError):
            n.parse(bad)
    with pytest.raises(n.NotationError):
        n.check_sources(n.parse("a@1:1"), {"b"})
    run = lambda r: {"hits": [{"id": f"{r['indexes'][0]}{k}"} for k in range(r["limit"])]}
    assert [h["id"] for h in n.retrieve(n.parse("a@0.5:2;!a@0.5:1"), "t", run)] == ["a0", "a1", "a0"]
    assert [h["id"] for h in n.retrieve(n.parse("a@0.5:2;!a@0.5:1"), "t", run, exclude=True)] == ["a1"]
    assert [h["id"] for h in n.retrieve(n.parse("a@0.5:2"), "t", run, before=lambda r: {**r, "limit": 1})] == ["a0"]
    assert [n.strategy(x) for x in ('["001"]', '["000"]', "[]", "it is 100", "")] == ["advanced_autoquery", "simple_rag", "simple_rag", "advanced_autoquery", "simple_rag"]


def test_documents():
    assert merge({"a": {"b": 1, "c": 2}, "d": 1}, {"a.b": 5, "a.c": None, "x.y": 1, "d": None}) == {"a": {"b": 5}}
    assert dict(leaves(json.loads('{"a": {"b": 1, "p": {"lat": 1, "lon": 2}}, "n": null}'))) == {"a.b": 1, "a.p": {"lat": 1, "lon": 2}}
    assert [humanize(k) for k in ("first_name", "firstName", "HTMLPage", "")] == ["First Name", "First Name", "HTML Page", ""]
    assert format_properties({"name": "x", "tags": ["a", 2], "n": {"k": 3}}, ["name", "tags", "n.k", "no"], {"tags"}) == "x. Tags a, 2. 3"
    assert fill_template("hi {{x}}", {"x": "y"}) == "hi y"


def test_dates():
    assert dates.parse("1970-01-02") == 86_400_000 and dates.parse("2023-01-01T00:00:00.5+01:00") == 1672527600500
    assert dates.parse("hello") is None and dates.parse("3235693") is None


def test_stems_agree(spark):
    from pyspark.sql import functions as F

    from quarry.functions.text import stem_expr

    words = "foxes fox running runs ran bus glasses cities kiss planned falling thing sing is boxes churches wished a ed ing étés".split()
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(stem_expr(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in rows] == [stem(w) for w in words]
    assert stem("foxes") == "fox" and stem("running") == "run"
    words = "chats chevaux grandes ai Häuser kindern casas luces gatti amiche ai corações heden bilarna x".split()
    for language in ("german", "french", "spanish", "italian", "portuguese", "dutch", "swedish", "other"):
        rows = spark.createDataFrame([(w,) for w in words], "w string").select(stem_expr(F.col("w"), language).alias("s")).collect()
        assert [r["s"] for r in rows] == [stem(w, language) for w in words]
    assert stem("chevaux", "french") == "cheval" and stem("felices", "spanish") == "feliz" and stem("ai", "italian") == "ai"


def test_embedding_batches(spark):
    from pyspark.sql import functions as F

    from quarry.functions.embedding import embed, for_query, passage

    df = spark.createDataFrame([("a", "one two three four", "x"), ("b", "", "y"), ("c", None, "z")], "id string, t string, u string")
    got = embed(df, "id", F.col("t"), lambda: lambda texts: [[float(len(x))] for x in texts], "e5", 2).orderBy("chunk").collect()
    assert [(r["id"], r["chunk"], r["embedding"]) for r in got] == [("a", 0, [16.0]), ("a", 1, [19.0])]
    assert for_query("e5", "q") == "query: q"
    assert [r[0] for r in df.select(passage(df, None)).collect()] == ["one two three four x", " y", "z"]
    assert [r[0] for r in df.select(passage(df, ["u", "t"])).collect()] == ["x. one two three four", "y. ", "z"]

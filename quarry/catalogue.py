"""The queries of the driver contract and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import filesystem, shared_path
from .events import by_day
from .functions.dates import lenient, millis
from .functions.documents import json_path, merge_json
from .functions.embedding import Encoder, passage
from .functions.geo import haversine
from .functions.text import chunks, explicit_enum, length_gate, stem_expr, tokens
from .language import constraints, notation
from .operators import facets as facet_ops
from .operators.ranking import PinRule, multiplied
from .operators.stats import field_stats, filterable_fields
from .operators.text_score import field_bm25, text_scores
from .operators.vector_score import fused, nearest
from .plans.params import Request
from .plans.search import Context, plan, search
from .plans.where import compile_where
from .sources.index import Index, Strategy, from_json, from_table
from .sources.store import Collection, latest, sample
from .streaming.oplog import State, consume, consume_again

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, name: str = "docs") -> Index:
    return from_table(name, read(spark, sf_dir, "documents"), "doc_id", texts=["text"])


def orders(spark: SparkSession, sf_dir: str) -> Index:
    df = read(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return from_table("orders", df, "o_orderkey", texts=[])


def rounded(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    return scores.select(F.col("ord").alias(key), F.round("score", 4).alias("score"))


TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def stem_sql(t: str) -> str:
    """The English stem of a term, spelled out for the checking engine."""
    cut = lambda k: f"left({t}, length({t}) - {k})"
    last = lambda k: f"right({cut(k)}, 1) = substr({t}, length({t}) - {k + 1}, 1) and right({cut(k)}, 1) not in ('l', 's', 'z') and length({t}) - {k} > 3"
    verb = lambda end: f"when {t} like '%{end}' and length({t}) - {len(end)} >= 3 and regexp_matches({cut(len(end))}, '[aeiouy]') then case when {last(len(end))} then {cut(len(end) + 1)} else {cut(len(end))} end"
    ends = (("ies", 3, "y", 4), ("sses", 4, "ss", 5), ("xes", 3, "x", 4), ("ches", 4, "ch", 5), ("shes", 4, "sh", 5))
    first = " ".join(f"when {t} like '%{e}' and length({t}) > {n} then {cut(k)} || '{new}'" for e, k, new, n in ends)
    return f"case {first} {verb('ing')} {verb('ed')} when {t} like '%s' and {t} not like '%ss' and {t} not like '%us' and {t} not like '%is' and length({t}) > 3 then {cut(1)} else {t} end"


def bm25_sql(words: list[str], table: str = "documents", key: str = "doc_id", fields: dict[str, float] | None = None, match: str = "exact", where: str = "true", need: int = 1, partition: str | None = None, boost: float = 1.0) -> str:
    """BM25F in SQL over ``fields`` (column to boost); match: exact, prefix or fuzzy N, the
    latter two on stems as well; ``partition``: a column whose values are indexes of their own."""
    fields = fields or {"text": 1.0}
    part = f"{partition} as part" if partition else "0 as part"
    toks = " union all ".join(f"select {key} as id, {part}, '{f}' as field, {b}::double as boost, ({where}) as ok, unnest({TOKENS.format(f)}) as term from {table}" for f, b in fields.items())
    test = {"exact": "p.term = q.word", "prefix": "starts_with(p.term, q.word)"}.get(match) or f"levenshtein(p.term, q.word) <= {match.split()[1]}"
    stems = "" if match == "exact" else f" union all select id, part, field, boost, ok, {stem_sql('term')} as term, true as stemmed from tok where {stem_sql('term')} <> term"
    q = ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))
    n = f"select {part}, count(*)::double as n from {table} group by 1" if partition else f"select 0 as part, count(*)::double as n from {table}"
    return f"""
with tok as ({toks}),
terms as (select id, part, field, boost, ok, term, false as stemmed from tok{stems}),
post as (select part, id, field, boost, ok, term, stemmed, count(*)::double as tf from terms group by all),
len as (select part, id, field, count(*)::double as len from tok group by all),
av as (select part, field, avg(len) as av from len group by all),
total as ({n}),
q(i, word) as (values {q}),
s as (
  select p.part, p.id, q.i, sum(p.tf / (0.25 + 0.75 * l.len / av.av) * p.boost * case when p.term = q.word and not p.stemmed then {boost} else 1.0 end) as s
  from post p join q on {test} join len l on l.part = p.part and l.id = p.id and l.field = p.field join av on av.part = p.part and av.field = p.field
  where p.ok group by all),
df as (select part, i, count(*)::double as df from s group by all),
r as (
  select s.part, s.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * s / (1.2 + s)) as score, count(*) as matched
  from s join df using (part, i) join total using (part) group by all)
select part, id, score from r where matched >= {need}"""


def _out(sql: str, key: str = "doc_id", tail: str = "") -> str:
    return f"select id as {key}, round(score, 4) as score from ({sql}) r {tail}"


TOP10 = "order by round(r.score, 6) desc, id limit 10"


def _text(term: str, top: bool = True, **request) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = documents(spark, sf_dir)
        if top:
            return rounded(plan({"docs": index}, Request.of({"term": term, **request})).hits)
        r = Request.of({"term": term, **request})
        allowed = index.docs.where(compile_where(index, r.where)).select("ord") if r.where else None
        return rounded(text_scores(index, r, allowed))

    return run


def _add(name: str, run: Query, sql: str | None) -> None:
    run.__name__ = name
    query(sql)(run)


_add("text_bm25_single", _text("the", exact=True), _out(bm25_sql(["the"]), tail=TOP10))
_add("text_bm25_multi", _text("the idiot der", False, exact=True), _out(bm25_sql(["the", "idiot", "der"])))
_add("text_threshold", _text("the and clown", False, exact=True, threshold=1.0), _out(bm25_sql(["the", "and", "clown"], need=3)))
_add("text_threshold_partial", _text("the and clown", False, exact=True, threshold=0.7), _out(bm25_sql(["the", "and", "clown"], need=2)))
_add("text_prefix", _text("worthl", False), _out(bm25_sql(["worthl"], match="prefix", boost=1.5)))
_add("text_fuzzy", _text("idiot", False, tolerance=1), _out(bm25_sql(["idiot"], match="fuzzy 1", boost=1.5)))
_add("text_stems", _text("idiots", False), _out(bm25_sql(["idiots", "idiot"], match="prefix", boost=1.5)))
_add("text_filtered", _text("the moron", False, exact=True, where={"lang": "en"}), _out(bm25_sql(["the", "moron"], where="lang = 'en'")))
_add("text_tolerance_zero", _text("clown", False, tolerance=0), _out(bm25_sql(["clown"], match="fuzzy 0", boost=1.5)))
_add("text_page", _text("the", exact=True, limit=20, offset=15), _out(bm25_sql(["the"]), tail="order by round(r.score, 6) desc, id limit 20 offset 15"))


@query(f"select doc_id, 1.0::double as score from documents where len({TOKENS.format('text')}) > 0")
def text_match_all(spark, sf_dir):
    return rounded(text_scores(documents(spark, sf_dir), Request("")))


@query(_out(bm25_sql(["sm", "ring"], table="part", key="p_partkey", fields={"p_name": 3.0, "p_type": 1.0}, match="prefix", boost=1.5), "p_partkey"))
def text_field_boost(spark, sf_dir):
    index = from_table("part", read(spark, sf_dir, "part"), "p_partkey", texts=["p_name", "p_type"])
    return rounded(text_scores(index, Request.of({"term": "sm ring", "boost": {"p_name": 3.0}})), "p_partkey")


@query(_out(bm25_sql(["rings", "ring"], table="part", key="p_partkey", fields={"p_name": 1.0}, match="prefix", boost=1.5), "p_partkey"))
def text_properties(spark, sf_dir):
    """One of two text fields, and one that doesn't exist."""
    index = from_table("part", read(spark, sf_dir, "part"), "p_partkey", texts=["p_name", "p_type"])
    return rounded(text_scores(index, Request.of({"term": "rings", "properties": ["p_name", "nothing"]})), "p_partkey")


@query(f"select id as p_partkey, round(sum(score), 4) as score from (({bm25_sql(['ring', 'economy'], table='part', key='p_partkey', fields={'p_name': 1.0})}) union all ({bm25_sql(['ring', 'economy'], table='part', key='p_partkey', fields={'p_type': 1.0})})) group by 1")
def text_field_bm25(spark, sf_dir):
    index = from_table("part", read(spark, sf_dir, "part"), "p_partkey", texts=["p_name", "p_type"])
    return rounded(field_bm25(index, "ring economy"), "p_partkey")


@query(f"with w as (select distinct p_name || 's' as word from part), t as (select distinct unnest({TOKENS.format('word')}) as word from w) select word, {stem_sql('word')} as stem from t")
def text_stem_table(spark, sf_dir):
    words = read(spark, sf_dir, "part").select(F.explode(tokens(F.concat("p_name", F.lit("s")))).alias("word")).distinct()
    return words.select("word", stem_expr(F.col("word")).alias("stem"))


def _by_language(spark, sf_dir) -> dict[str, Index]:
    df = read(spark, sf_dir, "documents")
    return {lang: from_table(lang, df.where(F.col("lang") == lang), "doc_id", texts=["text"]) for lang in ("de", "en", "es", "fr")}


@query(f"select part as index_id, id as doc_id, round(score, 4) as score from ({bm25_sql(['de', 'in'], partition='lang')}) r order by round(r.score, 6) desc, id, part limit 50")
def text_multi_index(spark, sf_dir):
    hits = plan(_by_language(spark, sf_dir), Request.of({"term": "de in", "exact": True, "limit": 50})).hits
    return hits.select("index_id", F.col("ord").alias("doc_id"), F.round("score", 4).alias("score"))


@query(f"select part as index_id, id as doc_id, round(score, 4) as score from ({bm25_sql(['de', 'in'], partition='lang')}) r where part in ('fr', 'es') order by round(r.score, 6) desc, id, part limit 40")
def text_selected_indexes(spark, sf_dir):
    hits = plan(_by_language(spark, sf_dir), Request.of({"term": "de in", "exact": True, "limit": 40, "indexes": ["fr", "es"]})).hits
    return hits.select("index_id", F.col("ord").alias("doc_id"), F.round("score", 4).alias("score"))


@query(f"with r as ({bm25_sql(['the'])}) select (select count(*) from r)::bigint as matched, (select count(*) from documents)::bigint as total")
def text_match_metrics(spark, sf_dir):
    m = search({"docs": documents(spark, sf_dir)}, {"term": "the", "exact": True, "metrics": True})["metrics"]
    return spark.createDataFrame([(m["matched"], m["total"])], "matched long, total long")


@query(f"select r.id as doc_id, round(score * coalesce(m, 1), 4) as score from ({bm25_sql(['the'])}) r left join (select doc_id, max(quality + 1.5)::double as m from labels group by 1) l on l.doc_id = r.id")
def text_multiplier(spark, sf_dir):
    index = documents(spark, sf_dir)
    m = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality") + 1.5).cast("double").alias("m"))
    scores = text_scores(index, Request("the", exact=True))
    return rounded(multiplied(scores, m.withColumnRenamed("doc_id", "ord"), F.col("m")))


@query(f"with t as (select doc_id, unnest({TOKENS.format('text')}) as term from documents) select term, count(distinct doc_id)::bigint as df, count(*)::bigint as n from t group by 1")
def vocab_stats(spark, sf_dir):
    return documents(spark, sf_dir).vocabulary().select("term", "df", "n")


@query(f"with t as (select doc_id, len({TOKENS.format('text')}) as n from documents) select count(*)::bigint as n_docs, sum(n)::bigint as n_tokens, round(avg(n), 4) as average from t where n > 0")
def corpus_stats(spark, sf_dir):
    return documents(spark, sf_dir).lengths.agg(F.count("*").alias("n_docs"), F.sum("len").cast("long").alias("n_tokens"), F.round(F.avg("len"), 4).alias("average"))


_STATS = """
select field, kind, n, coalesce(keys, 0)::bigint as keys, low, high from (
 select 'o_orderkey' as field, 'number' as kind, count(o_orderkey)::bigint as n, null::bigint as keys, min(o_orderkey)::double as low, max(o_orderkey)::double as high from orders
 union all select 'o_custkey', 'number', count(o_custkey)::bigint, null, min(o_custkey)::double, max(o_custkey)::double from orders
 union all select 'o_totalprice', 'number', count(o_totalprice)::bigint, null, min(o_totalprice), max(o_totalprice) from orders
 union all select 'o_orderdate', 'date', count(o_orderdate)::bigint, null, null, null from orders
 union all select 'o_orderstatus', 'string', count(o_orderstatus) filter (octet_length(encode(o_orderstatus)) between 1 and 25)::bigint, count(distinct o_orderstatus) filter (octet_length(encode(o_orderstatus)) between 1 and 25)::bigint, null, null from orders
 union all select 'o_orderpriority', 'string', count(o_orderpriority) filter (octet_length(encode(o_orderpriority)) between 1 and 25)::bigint, count(distinct o_orderpriority) filter (octet_length(encode(o_orderpriority)) between 1 and 25)::bigint, null, null from orders)"""


@query(_STATS)
def filterable_field_stats(spark, sf_dir):
    return filterable_fields(orders(spark, sf_dir)).select("field", "kind", "n", F.coalesce("keys", F.lit(0)).alias("keys"), "low", "high")


@query(f"with t as (select doc_id, unnest({TOKENS.format('text')}) as term from documents), l as (select doc_id, count(*) as n from t group by 1) select 'text' as field, (select count(*) from l)::bigint as n, (select count(distinct term) from t)::bigint as keys, (select round(avg(n), 4) from l) as average_length")
def text_field_stats(spark, sf_dir):
    return field_stats(documents(spark, sf_dir)).where("kind = 'text'").select("field", "n", "keys", F.round("average_length", 4).alias("average_length"))


# filters


def _where(table: str, key: str, where: dict, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Query:
    def run(spark, sf_dir):
        index = from_table(table, prepare(read(spark, sf_dir, table)), key, texts=[])
        return index.docs.where(compile_where(index, where)).select(key)

    return run


def _dates(df: DataFrame) -> DataFrame:
    return df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


def _ids(table: str, key: str, test: str) -> str:
    return f"select {key} from {table} where {test}"


_LINE = ("lineitem", "id")


def _lines(spark, sf_dir) -> Index:
    df = read(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return from_table("lineitem", df.withColumnRenamed("id", "line"), "line", texts=[])


for _op, _arg, _sql in (("eq", 10, "= 10"), ("gt", 45.5, "> 45.5"), ("gte", 49, ">= 49"), ("lt", 2, "< 2"), ("lte", 1.5, "<= 1.5"), ("between", [10, 12], "between 10 and 12")):

    def _run(spark, sf_dir, op=_op, arg=_arg):
        index = _lines(spark, sf_dir)
        return index.docs.where(compile_where(index, {"l_quantity": {op: arg}})).select("line")

    _add(f"where_number_{_op}", _run, f"select l_orderkey * 10 + l_linenumber as line from lineitem where l_quantity {_sql}")

_add("where_date_between", _where("orders", "o_orderkey", {"o_orderdate": {"between": ["1995-01-01", "1995-06-30T12:00:00Z"]}}, _dates), _ids("orders", "o_orderkey", "o_orderdate between timestamp '1995-01-01' and timestamp '1995-06-30 12:00:00'"))
_add("where_date_gt", _where("orders", "o_orderkey", {"o_orderdate": {"gt": "1997-12-31"}}, _dates), _ids("orders", "o_orderkey", "o_orderdate > timestamp '1997-12-31'"))
_add("where_enum", _where("customer", "c_custkey", {"c_mktsegment": "BUILDING"}), _ids("customer", "c_custkey", "c_mktsegment = 'BUILDING' and octet_length(encode(c_mktsegment)) between 1 and 25"))
_add("where_and_or_not", _where("orders", "o_orderkey", {"o_totalprice": {"gte": 1000}, "and": [{"o_orderstatus": "F"}, {"o_custkey": {"lt": 1000}}], "or": [{"o_orderpriority": "1-URGENT"}, {"o_totalprice": {"gt": 200000}}], "not": {"o_custkey": {"between": [10, 20]}}}, _dates), _ids("orders", "o_orderkey", "o_totalprice >= 1000 and o_orderstatus = 'F' and o_custkey < 1000 and (o_orderpriority = '1-URGENT' or o_totalprice > 200000) and not coalesce(o_custkey between 10 and 20, false)"))
_add("where_or_empty", _where("orders", "o_orderkey", {"or": []}, _dates), _ids("orders", "o_orderkey", "false"))
_add("where_unknown_field", _where("orders", "o_orderkey", {"nothing": 1 == 1, "o_orderstatus": "F"}, _dates), _ids("orders", "o_orderkey", "false"))
_add("where_mismatch", _where("orders", "o_orderkey", {"o_totalprice": "F"}, _dates), _ids("orders", "o_orderkey", "false"))
_add("where_not_mismatch", _where("orders", "o_orderkey", {"not": {"o_totalprice": "F"}}, _dates), _ids("orders", "o_orderkey", "true"))


def _labelled(spark, sf_dir) -> Index:
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    df = read(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("toxic", F.col("toxic") == 1)
    return from_table("labelled", df, "doc_id", texts=[])


_LABELLED = "(select d.*, l.toxic = 1 as toxic from documents d left join (select doc_id, max(toxic) as toxic from labels group by 1) l using (doc_id))"


@query(f"select doc_id from {_LABELLED} where toxic")
def where_bool(spark, sf_dir):
    index = _labelled(spark, sf_dir)
    return index.docs.where(compile_where(index, {"toxic": True})).select("doc_id")


@query(f"select doc_id from {_LABELLED} where not coalesce(toxic, false)")
def where_not_lacking(spark, sf_dir):
    index = _labelled(spark, sf_dir)
    return index.docs.where(compile_where(index, {"not": {"toxic": True}})).select("doc_id")


@query("select p_partkey, p_type from part where octet_length(encode(p_type)) between 1 and 20")
def where_length_gate(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", length_gate(F.col("p_type"), 1, 20).alias("p_type")).where("p_type is not null")


@query(f"select doc_id from documents where list_contains({TOKENS.format('text')}, 'clown')")
def where_array_any(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("words"))
    index = from_table("arrays", df, "doc_id")
    return index.docs.where(compile_where(index, {"words": "clown"})).select("doc_id")


_LAT, _LON = "((c_custkey * 37) % 180 - 90)::double", "((c_custkey * 91) % 360 - 180)::double"
_HAV = f"2 * 6371008.8 * asin(sqrt(least(pow(sin(radians({_LAT} - 9.14) / 2), 2) + cos(radians(9.14)) * cos(radians({_LAT})) * pow(sin(radians({_LON} - 45.23) / 2), 2), 1.0)))"


def _places(spark, sf_dir) -> Index:
    point = F.struct(((F.col("c_custkey") * 37) % 180 - 90).cast("double").alias("lat"), ((F.col("c_custkey") * 91) % 360 - 180).cast("double").alias("lon"))
    return from_table("places", read(spark, sf_dir, "customer").select("c_custkey", point.alias("place")), "c_custkey", texts=[])


def _geo(value: dict) -> Query:
    def run(spark, sf_dir):
        index = _places(spark, sf_dir)
        return index.docs.where(compile_where(index, {"place": value})).select("c_custkey")

    return run


_AT = {"coordinates": {"lat": 9.14, "lon": 45.23}, "value": 3000, "unit": "km"}
_POLYGON = [(-40.5, -100.5), (50.5, -80.5), (60.5, 70.5), (-20.5, 90.5)]


def _crossings() -> str:
    out = []
    for (a, b), (c, d) in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1]):
        out.append(f"case when (({a} > {_LAT}) <> ({c} > {_LAT})) and {_LON} < ({_LAT} - ({a})) * ({(d - b) / (c - a)!r}::double) + ({b}) then 1 else 0 end")
    return "(" + " + ".join(out) + ") % 2 = 1"


_add("where_geo_radius", _geo({"radius": _AT}), _ids("customer", "c_custkey", f"{_HAV} <= 3000000"))
_add("where_geo_outside", _geo({"radius": {**_AT, "inside": False}}), _ids("customer", "c_custkey", f"{_HAV} > 3000000"))
_add("where_geo_polygon", _geo({"polygon": {"coordinates": [{"lat": a, "lon": b} for a, b in _POLYGON]}}), _ids("customer", "c_custkey", _crossings()))


@query(f"select c_custkey, round({_HAV}, 3) as metres from customer")
def geo_distance(spark, sf_dir):
    return _places(spark, sf_dir).docs.select("c_custkey", F.round(haversine(F.col("place.lat"), F.col("place.lon"), 9.14, 45.23), 3).alias("metres"))


# facets and groups


def _all(index: Index) -> DataFrame:
    return index.docs.select("ord", F.lit(1.0).alias("score"))


_RANGES = [(0, 10), (10, 20), (5, 15), (20, 50), (60, 70)]


@query(" union all ".join(f"select '{a}-{b}' as label, count(*)::bigint as n from lineitem where l_quantity between {a} and {b}" for a, b in _RANGES))
def facet_number(spark, sf_dir):
    index = _lines(spark, sf_dir)
    return facet_ops.facet([(index, _all(index))], "l_quantity", {"ranges": [{"from": a, "to": b} for a, b in _RANGES]})


@query(f"select 'true' as label, count(*) filter (toxic)::bigint as n from {_LABELLED} union all select 'false', count(*) filter (not toxic)::bigint from {_LABELLED}")
def facet_bool(spark, sf_dir):
    index = _labelled(spark, sf_dir)
    return facet_ops.facet([(index, _all(index))], "toxic", {"true": True, "false": True})


@query("with k as (select distinct o_orderpriority as label from orders), c as (select o_orderpriority as label, count(*) as n from orders where o_totalprice < 2000 group by 1) select label, coalesce(n, 0)::bigint as n from k left join c using (label)")
def facet_string(spark, sf_dir):
    index = orders(spark, sf_dir)
    scored = index.docs.where("o_totalprice < 2000").select("ord", F.lit(1.0).alias("score"))
    return facet_ops.facet([(index, scored)], "o_orderpriority", {})


@query(f"with r as ({bm25_sql(['idiot'])}), k as (select distinct lang as label from documents) select label, count(r.id)::bigint as n from k left join (select lang, id from r join documents on doc_id = id) r on r.lang = k.label group by 1")
def facet_ignores_where(spark, sf_dir):
    p = plan({"docs": documents(spark, sf_dir)}, Request.of({"term": "idiot", "exact": True, "where": {"lang": "en", "source": "src1"}, "facets": {"lang": {}}}))
    return p.facets["lang"]


@query("select o_orderstatus as k0, count(*)::bigint as n from orders group by 1")
def group_one(spark, sf_dir):
    index = orders(spark, sf_dir)
    g = facet_ops.groups([(index, _all(index))], ["o_orderstatus"])
    return g.select(F.col("values")[0].alias("k0"), "n")


@query("with a as (select distinct o_orderstatus as k0 from orders), b as (select distinct o_orderpriority as k1 from orders), c as (select o_orderstatus as k0, o_orderpriority as k1, count(*) as n from orders where o_totalprice > 250000 group by all) select k0, k1, coalesce(n, 0)::bigint as n from a cross join b left join c using (k0, k1)")
def group_empty_combinations(spark, sf_dir):
    index = orders(spark, sf_dir)
    scored = index.docs.where("o_totalprice > 250000").select("ord", F.lit(1.0).alias("score"))
    g = facet_ops.groups([(index, scored)], ["o_orderstatus", "o_orderpriority"])
    return g.select(F.col("values")[0].alias("k0"), F.col("values")[1].alias("k1"), "n")


@query(f"with r as ({bm25_sql(['the', 'clown'])}), d as (select source, id, score, row_number() over (partition by source order by round(score, 6) desc, id) as place from r join documents on doc_id = id) select source, place::bigint as place, id as doc_id from d where place <= 3")
def group_top_score(spark, sf_dir):
    p = plan({"docs": documents(spark, sf_dir)}, Request.of({"term": "the clown", "exact": True, "groupBy": {"properties": ["source"], "max_results": 3}}))
    return p.groups.select(F.col("values")[0].alias("source"), F.posexplode("result").alias("place", "hit")).select("source", (F.col("place") + 1).cast("long").alias("place"), F.col("hit.ord").alias("doc_id"))


@query("with d as (select o_orderpriority as k, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as place from orders) select k, place::bigint as place, o_orderkey from d where place <= 5")
def group_top_sorted(spark, sf_dir):
    index = orders(spark, sf_dir)
    g = facet_ops.groups([(index, _all(index))], ["o_orderpriority"], 5, ("o_totalprice", "DESC"))
    return g.select(F.col("values")[0].alias("k"), F.posexplode("result").alias("place", "hit")).select("k", (F.col("place") + 1).cast("long").alias("place"), F.col("hit.ord").alias("o_orderkey"))


# order


def _sorted(field: str, order: str, limit: int = 25, offset: int = 0) -> Query:
    def run(spark, sf_dir):
        index = orders(spark, sf_dir)
        index.texts = {"o_orderpriority": from_table("t", read(spark, sf_dir, "orders"), "o_orderkey").texts["o_orderpriority"]}
        r = Request.of({"term": "", "sortBy": {"property": field, "order": order}, "limit": limit, "offset": offset})
        return plan({"orders": index}, r).hits.select(F.col("ord").alias("o_orderkey"))

    return run


for _name, _args, _by in (("sort_number", ("o_totalprice", "ASC"), "o_totalprice, o_orderkey limit 25"), ("sort_number_desc", ("o_totalprice", "DESC"), "o_totalprice desc, o_orderkey limit 25"), ("sort_date", ("o_orderdate", "DESC"), "o_orderdate desc, o_orderkey limit 25"), ("page_offset", ("o_totalprice", "ASC", 10, 100), "o_totalprice, o_orderkey limit 10 offset 100")):
    _add(_name, _sorted(*_args), f"select o_orderkey from orders order by {_by}")


@query(f"select doc_id from {_LABELLED} where toxic is not null order by toxic, doc_id limit 60")
def sort_bool_missing(spark, sf_dir):
    index = _labelled(spark, sf_dir)
    index.texts = documents(spark, sf_dir).texts
    return plan({"labelled": index}, Request.of({"term": "", "sortBy": {"property": "toxic"}, "limit": 60})).hits.select(F.col("ord").alias("doc_id"))


_RULE = PinRule("r", [{"pattern": "the", "anchoring": "is"}], {"5": 1, "7": 2, "3": 40})


def _pinned_sql(low: int, high: int) -> str:
    return f"with r as (select id, row_number() over (order by round(score, 6) desc, id) - 1 as p from ({bm25_sql(['the'])})), o as (select id, row_number() over (order by p) - 1 as p from r where id not in (5, 7, 3)), b as (select 5 as id, 1 as p union all select id, case when p < 1 then p else p + 2 end from o union all select 7, 2) select id as doc_id, (p - {low})::bigint as place from b where p >= {low} and p < {high}"


def _pins(limit: int, offset: int) -> Query:
    def run(spark, sf_dir):
        hits = search({"docs": documents(spark, sf_dir)}, {"term": "the", "exact": True, "limit": limit, "offset": offset}, Context(pins=[_RULE]))["hits"]
        return spark.createDataFrame([(int(h["id"].split(":")[1]), i) for i, h in enumerate(hits)], "doc_id long, place long")

    return run


_add("pins", _pins(10, 0), _pinned_sql(0, 10))
_add("pins_offset", _pins(5, 2), _pinned_sql(2, 7))


@query("with p as (select *, row_number() over (partition by p_brand order by p_partkey) as r from part where starts_with(p_type, 'ECONOMY') and p_partkey <> 9), pin as (select p_brand from part where p_partkey = 9), a as (select p_brand, p_partkey, r * 2 as k from p union all select p_brand, 9, 3 from pin), b as (select p_brand, p_partkey, row_number() over (partition by p_brand order by k) as n from a) select p_brand, p_partkey, (n - 1)::bigint as place from b where n <= 3")
def pins_in_groups(spark, sf_dir):
    """A pinned document takes its place in its group, whether it matches or not."""
    index = from_table("part", read(spark, sf_dir, "part"), "p_partkey", texts=["p_type"])
    rule = PinRule("r", [{"pattern": "economy", "anchoring": "is"}], {"9": 1})
    out = search({"part": index}, {"term": "economy", "exact": True, "groupBy": {"properties": ["p_brand"], "max_results": 3}}, Context(pins=[rule]))
    rows = [(g["values"][0], int(h["id"].split(":")[1]), i) for g in out["groups"] for i, h in enumerate(g["result"])]
    return spark.createDataFrame(rows, "p_brand string, p_partkey long, place long")


# vectors


def _vectors(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), "embedding", "label")


def _query_vector(spark, sf_dir) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


_COS = "(select vec_id, label, list_cosine_similarity(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]) as s from embeddings)"


@query(f"select vec_id, round(s, 4) as score from {_COS} order by s desc, vec_id limit 20")
def vec_knn(spark, sf_dir):
    return rounded(nearest(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 20, -1.0), "vec_id")


@query(f"select vec_id, round(s, 4) as score from {_COS} where s >= 0.3")
def vec_threshold(spark, sf_dir):
    return rounded(nearest(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), None, 0.3), "vec_id")


@query(f"select label::bigint as label, round(sum(s), 4) as score from {_COS} where s >= 0.1 group by 1")
def vec_chunk_sum(spark, sf_dir):
    chunks_ = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("ord"), "embedding")
    return rounded(nearest(chunks_, _query_vector(spark, sf_dir), None, 0.1), "label")


@query(f"select vec_id, round((greatest(least(s, 1), 0.7) - 0.7) / 0.3, 4) as score from {_COS} where (greatest(least(s, 1), 0.7) - 0.7) / 0.3 >= 0")
def vec_rescale(spark, sf_dir):
    return rounded(nearest(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), None, 0.0, True), "vec_id")


@query(f"select vec_id, round(s, 4) as score from {_COS} where label = (select label from embeddings where vec_id = 0) order by s desc, vec_id limit 10")
def vec_filtered(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    allowed = v.join(F.broadcast(v.where("ord = 0").select("label")), "label").select("ord")
    return rounded(nearest(v, _query_vector(spark, sf_dir), 10, -1.0, allowed=allowed), "vec_id")


@query(f"with t as (select id, score from ({bm25_sql(['the', 'clown'])})), v as (select vec_id as id, s as score from {_COS} order by s desc, vec_id limit 100), b as (select * from t union all select * from v where score >= 0.1), e as (select least(min(score), 0) as low, greatest(max(score), 0) as high from b) select id as doc_id, round(sum((score - low) / (high - low)), 4) as score from b, e group by 1")
def hybrid(spark, sf_dir):
    text = text_scores(documents(spark, sf_dir), Request("the clown", exact=True))
    return rounded(fused(text, nearest(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 100, 0.1)))


# changes


def _ops(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("value"))


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def upsert_latest(spark, sf_dir):
    return latest(_ops(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


_BUILT: dict[tuple[str, str, str], Collection] = {}


def _parts(df: DataFrame) -> DataFrame:
    """``ord, body`` of parts as JSON documents."""
    fields = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.struct(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")).alias("is"), F.array("p_type", "p_brand").alias("tags"))
    return df.select(F.col("p_partkey").alias("ord"), F.to_json(fields).alias("body"))


def letters() -> Encoder:
    """An encoder for tests: how often a text has each letter."""
    import string

    return lambda texts: [[float(t.count(c)) for c in string.ascii_lowercase] for t in texts]


def shop(spark, sf_dir: str, kind: str = "read", build: Callable[[Collection], None] | None = None) -> Collection:
    """A collection of parts, built once a session and table; ``kind`` keeps those apart that are changed."""
    at = (spark.sparkContext.applicationId, sf_dir, kind)
    if at not in _BUILT:
        c = Collection(spark, shared_path(spark, "collections"), "shop", make_encoder=letters)
        c.create_index("parts", embedding=["name", "brand"])
        c.insert("parts", _parts(read(spark, sf_dir, "part")))
        if build:
            build(c)
        _BUILT[at] = c
    return _BUILT[at]


def _fields(**paths: str) -> list[Column]:
    return [F.get_json_object("body", p).cast(k.split("__")[1] if "__" in k else "string").alias(k.split("__")[0]) for k, p in paths.items()]


def _body(df: DataFrame, **paths: str) -> DataFrame:
    return df.select(*_fields(**paths))


@query("select p_partkey from part where p_brand <> 'Brand#7'")
def delete_documents(spark, sf_dir):
    c = shop(spark, sf_dir, "deleted", lambda c: c.delete("parts", c.documents("parts").where(F.get_json_object("body", "$.brand") == "Brand#7").select(F.concat(F.lit("parts:"), "id").alias("id"))))
    return c.documents("parts").select(F.col("id").cast("long").alias("p_partkey"))


@query("select p_partkey, case when p_partkey % 2 = 0 then 'new' else p_name end as name, case when p_partkey % 3 = 0 then null else p_brand end as brand, case when p_partkey % 2 = 1 and p_partkey % 3 = 0 then 100 + p_size else p_size end as size from part where p_partkey % 5 <> 0 union all select 1000000 + p_partkey, 'added', null, -1 from part where p_partkey < 3")
def collection_changes(spark, sf_dir):
    """Documents after patches, replacements, deletions and additions, over several segments."""

    def build(c: Collection) -> None:
        p = read(spark, sf_dir, "part")
        patch = F.concat(F.lit('{"id":"'), F.col("p_partkey"), F.lit('","brand":null'), F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit(',"is.size":'), F.col("p_size") + 100)).otherwise(""), F.lit("}"))
        c.insert("parts", _parts(p.where("p_partkey % 2 = 0").withColumn("p_name", F.lit("new"))))
        c.update("parts", p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("ord"), patch.alias("body")))
        c.delete("parts", p.where("p_partkey % 5 = 0").select(F.col("p_partkey").cast("string").alias("id")))
        # Ids of their own: in larger tables there are parts of those numbers, which these mustn't replace.
        added = F.struct(F.concat(F.lit("added-"), "p_partkey").alias("id"), (F.col("p_partkey") + 1_000_000).alias("key"), F.lit("added").alias("name"))
        c.insert("parts", p.where("p_partkey < 3").select(F.col("p_partkey").alias("ord"), F.to_json(added).alias("body")))

    docs = shop(spark, sf_dir, "changed", build).documents("parts")
    key = F.coalesce(F.get_json_object("body", "$.key"), F.get_json_object("body", "$.id")).cast("bigint")
    return docs.select(key.alias("p_partkey"), *_fields(name="$.name", brand="$.brand", size__int="$.is.size")).fillna(-1, "size")


@query("select p_partkey, p_name from part where p_partkey in (3, 5, 7, 11, 13)")
def batch_get(spark, sf_dir):
    rows = shop(spark, sf_dir).get_rows([f"parts:{i}" for i in (3, 5, 7, 11, 13, 3, -1)])
    return _body(rows, p_partkey__bigint="$.id", p_name="$.name")


@query("select count(*)::bigint as n from part")
def collection_count(spark, sf_dir):
    return spark.createDataFrame([(shop(spark, sf_dir).count(),)], "n long")


@query("select p_partkey, p_name || ' (2)' as p_name from part")
def replace_index(spark, sf_dir):
    """An index that was built aside and put in the place of another."""

    def build(c: Collection) -> None:
        c.create_index("aside", temporary_of="parts")
        c.insert("aside", _parts(read(spark, sf_dir, "part").withColumn("p_name", F.concat("p_name", F.lit(" (2)")))))
        c.replace_index("parts", "aside")

    return _body(shop(spark, sf_dir, "replaced", build).documents("parts"), p_partkey__bigint="$.id", p_name="$.name")


@query("select p_partkey from part where p_brand = 'Brand#7' and octet_length(encode(p_brand)) <= 7")
def reindex_strategy(spark, sf_dir):
    """The same documents under a shorter limit for values to filter by."""
    c = shop(spark, sf_dir, "reindexed", lambda c: c.reindex("parts", Strategy(longest=7)))
    index = c.index("parts")
    return index.docs.where(compile_where(index, {"brand": "Brand#7"})).select(F.col("id").cast("long").alias("p_partkey"))


@query(_out(bm25_sql(["rings", "ring"], table="(select p_partkey, p_name as name, p_brand as brand, p_type || ' ' || p_brand as tags, p_size from part)", key="p_partkey", fields={"name": 2.0, "brand": 1.0, "tags": 1.0}, match="prefix", boost=1.5, where="p_size >= 10"), "p_partkey"))
def collection_search(spark, sf_dir):
    """A filtered full-text search over the postings that a collection wrote."""
    index = shop(spark, sf_dir).index("parts")
    p = plan({"parts": index}, Request.of({"term": "rings", "boost": {"name": 2.0}, "where": {"is.size": {"gte": 10}}, "limit": 1_000_000}))
    return p.hits.join(index.docs.select("ord", "id"), "ord").select(F.col("id").cast("long").alias("p_partkey"), F.round("score", 4).alias("score"))


def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"(length({text}) - length(replace({text}, '{c}', '')))::double" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


@query(f"with v as (select p_partkey, round(list_cosine_similarity({_letters_sql('t')}, {_letters_sql(chr(39) + 'small ring' + chr(39))}), 4) as score from (select p_partkey, array_to_string({TOKENS.format(chr(40) + 'p_name || ' + chr(39) + '. ' + chr(39) + ' || p_brand' + chr(41))}, ' ') as t from part)) select * from v where score >= 0.9")
def collection_vectors(spark, sf_dir):
    """A vector search over what a collection embedded when documents came in: all that reach the
    similarity, be they more than any page has, and so in no order."""
    index = shop(spark, sf_dir).index("parts")
    scores = [nearest(rows, letters()(["small ring"])[0], None, 0.5) for rows in index.vector_rows().values()]
    hits = multiplied(scores[0], index.docs, index.multiplier).join(index.docs.select("ord", "id"), "ord").select(F.col("id").cast("long").alias("p_partkey"), F.round("score", 4).alias("score"))
    return hits.where("score >= 0.9")


@query("select field, kind from (values ('name', 'string'), ('brand', 'string'), ('is.size', 'number'), ('is.price', 'number'), ('tags', 'string')) t(field, kind)")
def collection_schema(spark, sf_dir):
    return shop(spark, sf_dir).filterable_fields("parts").select("field", "kind")


@query("select doc_id, case when quality = 0 then null else lang end as lang, n_chars + 1 as n_chars from documents join (select doc_id, max(quality) as quality from labels group by 1) using (doc_id)")
def merge_patches(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("lang", F.struct("n_chars").alias("size"))).alias("body"), "n_chars")
    patches = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    drop = F.when(F.col("q") == 0, F.array(F.lit('{"lang":null}'))).otherwise(F.array().cast("array<string>"))
    deep = F.array(F.concat(F.lit('{"size.n_chars":'), (F.col("n_chars") + 1).cast("string"), F.lit("}")))
    merged = docs.join(patches, "doc_id").select("doc_id", merge_json(F.col("body"), F.concat(drop, deep)).alias("body"))
    return merged.select("doc_id", F.get_json_object("body", "$.lang").alias("lang"), F.get_json_object("body", "$.size.n_chars").cast("long").alias("n_chars"))


@query("select p::bigint as pos, p_partkey, p_name from part join (values (0, 5), (1, 3), (2, 1), (3, 7)) s(p, id) on p_partkey = id")
def shelf_order(spark, sf_dir):
    c = shop(spark, sf_dir)
    c.insert_shelf("best", ["5", "3", "1", "7", "-1"])
    return c.shelf_rows("best").select(F.col("pos").cast("long").alias("pos"), F.get_json_object("body", "$.id").cast("long").alias("p_partkey"), F.get_json_object("body", "$.name").alias("p_name"))


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def oplog_stream(spark, sf_dir):
    """The event table as a stream of operations, consumed into the latest state by user."""
    fs, source = filesystem(f"{sf_dir}/events.parquet")
    whole = fs.get_file_info(source).is_file  # a stream reads folders, or what a pattern finds
    root = shared_path(spark, "oplog")
    stream = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/event[s].parquet" if whole else f"{sf_dir}/events.parquet")
    state = State(spark, f"{root}/state", "user_id", "event_id")
    consume_again(lambda: consume(stream.select("event_id", "user_id", "event_type", "value"), state, f"{root}/checkpoint"))
    return state.read().select("user_id", "event_id", "event_type", "value")


_WORDS = TOKENS.format("text")


@query(f"with t as (select doc_id, {_WORDS} as w from documents), s as (select doc_id, w, unnest(range(0, greatest(ceil((len(w) - 100) / 98.0), 0)::bigint + 1)) as i from t) select doc_id, i::bigint as chunk, array_to_string(w[i * 98 + 1 : i * 98 + 100], ' ') as text from s")
def chunk_text(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks(F.col("text"), 100)).alias("chunk", "text"))
    return df.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "text")


def _constraints(queries: DataFrame) -> DataFrame:
    return constraints.numeric_table(queries, "text").select("id", F.inline("constraints"))


_ASKED = "select p_partkey as id, case p_partkey % 6 when 0 then 'under $' || p_size || ' and rated at least four' when 1 then 'between ' || p_size || ' and ' || (p_size + 10) || ' eur, over 3' when 2 then 'no less than ' || p_size || ' cm' when 3 then '$' || p_size || '-$' || (p_size * 2) || ' exactly 7' when 4 then 'at most 1,5' || (10 + p_size) || ' or 2k' else p_name end as text from part"


@query(constraints.numeric_sql(_ASKED.replace("at least four", "at least 4")))
def nlq_constraints(spark, sf_dir):
    """Limits that queries state in words; one number is a word as well."""
    read(spark, sf_dir, "part").createOrReplaceTempView("_asked_parts")
    return _constraints(spark.sql(_ASKED.replace("from part", "from _asked_parts")))


@query(constraints.numeric_sql("select conv_id * 1000 + turn as id, lower(text) as text from conversations where role = 'user'"))
def nlq_conversations(spark, sf_dir):
    users = read(spark, sf_dir, "conversations").where("role = 'user'")
    return _constraints(users.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))


@query("select strftime(ts, '%Y-%m-%d') as day, event_type as kind, count(*)::bigint as n, round(sum(value), 4) as total from events group by all")
def analytics_daily(spark, sf_dir):
    return by_day(read(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("day", F.col("day").cast("string"))


@query("select user_id, count(*)::bigint as n, count(distinct event_type)::bigint as kinds from events group by 1")
def analytics_by_user(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


@query("select doc_id from documents order by md5(doc_id || ':0'), doc_id::varchar limit 25")
def training_sample(spark, sf_dir):
    return sample(read(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string")), 25).select("doc_id")


@query("select o_orderkey, epoch_ms(o_orderdate::timestamp)::bigint as ms from orders")
def lenient_dates(spark, sf_dir):
    """Dates written in four ways."""
    o = read(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("timestamp")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "yyyy/MM/dd")).when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return o.select("o_orderkey", millis(lenient(text)).alias("ms"))


@query("select p_partkey, case when p_partkey % 3 < 2 then p_brand end as value from part")
def explicit_enums(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("enum('"), "p_brand", F.lit("')"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("enum(`"), "p_brand", F.lit("`)"))).otherwise(F.col("p_brand"))
    return p.select("p_partkey", explicit_enum(text).alias("value"))


@query("select p_partkey, concat_ws(' ', p_name, p_brand, p_type) as text from part")
def passage_texts(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", passage(p, None).alias("text"))


@query("select p_partkey, concat_ws('. ', p_type, p_name) as text from part")
def passage_chosen(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", passage(p, ["p_type", "p_name"]).alias("text"))


@query("select user_id, (json_extract(props, '$.k'))::bigint as k from events")
def json_values(spark, sf_dir):
    v = F.try_variant_get(F.parse_json("props"), json_path("k"), "bigint")
    return read(spark, sf_dir, "events").select("user_id", v.alias("k"))


@query(f"with t as (select distinct doc_id, lang, unnest({TOKENS.format('text')}) as w from documents), k as (select w from t where w in ('clown', 'idiot', 'moron', 'loser')) select w as label, count(*)::bigint as n from k group by 1")
def facet_array(spark, sf_dir):
    """A document counts once for each of its values."""
    df = read(spark, sf_dir, "documents").select("doc_id", F.filter(tokens(F.col("text")), lambda w: w.isin("clown", "idiot", "moron", "loser")).alias("words"))
    index = from_table("arrays", df, "doc_id")
    return facet_ops.facet([(index, _all(index))], "words", {})


@query("select n_name as label, count(c_custkey)::bigint as n from nation left join customer on c_nationkey = n_nationkey where n_regionkey < 2 group by 1")
def facet_two_indexes(spark, sf_dir):
    """One facet over the indexes of two regions."""
    both = []
    for r in (0, 1):
        n = read(spark, sf_dir, "nation").where(F.col("n_regionkey") == r)
        df = n.join(read(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn("key", F.coalesce("c_custkey", -1 - F.col("n_nationkey")))
        index = from_table(f"region{r}", df.select("key", "n_name", "c_custkey"), "key")
        both.append((index, index.docs.where("c_custkey is not null").select("ord", F.lit(1.0).alias("score"))))
    return facet_ops.facet(both, "n_name", {})


@query("select o_orderpriority as k, count(*)::bigint as n from orders group by 1")
def group_lacking_property(spark, sf_dir):
    """An index without the property contributes nothing."""
    a, b = orders(spark, sf_dir), from_table("part", read(spark, sf_dir, "part"), "p_partkey", texts=[])
    g = facet_ops.groups([(a, _all(a)), (b, _all(b))], ["o_orderpriority"])
    return g.select(F.col("values")[0].alias("k"), "n")


@query("select tag as k, count(*)::bigint as n from (select unnest([p_type, p_brand]) as tag from part) group by 1")
def group_array(spark, sf_dir):
    index = shop(spark, sf_dir).index("parts")
    return facet_ops.groups([(index, _all(index))], ["tags"]).select(F.col("values")[0].alias("k"), "n")


@query("select o_orderkey from orders where o_orderkey = 17 or o_custkey between 3 and 5")
def where_whole_numbers(spark, sf_dir):
    """Whole numbers are compared as such; limits may have fractions."""
    index = orders(spark, sf_dir)
    return index.docs.where(compile_where(index, {"or": [{"o_orderkey": {"eq": 17}}, {"o_custkey": {"between": [2.5, 5.5]}}]})).select("o_orderkey")


@query("select 9007199254740993 + i as n from range(4) t(i) where i >= 1")
def where_beyond_doubles(spark, sf_dir):
    """Numbers of JSON documents that doubles can't tell apart."""
    docs = spark.range(4).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), F.format_string('{"n": %d}', F.col("id") + 9007199254740993).alias("body"))
    index = from_json("wide", docs, schema={"n": "number"})
    return index.docs.where(compile_where(index, {"n": {"gt": 9007199254740993}})).select(F.col("w0").alias("n"))


@query("with a as (select 'fr' as i union all select 'es'), r as (" + f"select part, id, row_number() over (partition by part order by round(score, 6) desc, id) as k from ({bm25_sql(['de', 'in'], partition='lang')})" + ") select part as index_id, id as doc_id from r join a on a.i = part where k <= case part when 'fr' then 3 else 2 end")
def notation_retrieval(spark, sf_dir):
    """The hits of each component of a context notation."""
    indexes = _by_language(spark, sf_dir)
    hits = notation.retrieve(notation.parse("fr@0:3; es@0.5:2+"), "de in", lambda r: search(indexes, {**r, "exact": True}), "fulltext")
    return spark.createDataFrame([(h["index_id"], int(h["id"].split(":")[1])) for h in hits], "index_id string, doc_id long")


@query("select doc_id, concat_ws(':', lang, doc_id) as id from documents")
def public_ids(spark, sf_dir):
    from .functions.documents import public_id

    return read(spark, sf_dir, "documents").select("doc_id", public_id(F.col("lang"), F.col("doc_id").cast("string")).alias("id"))


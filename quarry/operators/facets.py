"""Facets and groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.params import InvalidFacet, InvalidGroupField
from ..sources.index import Field, Index


def label(x) -> str:
    return str(int(x)) if float(x) == int(x) else str(float(x))


def _values(docs: DataFrame, f: Field) -> DataFrame:
    """ord, value; a row for each distinct value of an array."""
    return docs.select("ord", F.explode(F.array_distinct(f.column)).alias("value") if f.array else f.column.alias("value")).where("value is not null")


def number_facet(docs: DataFrame, f: Field, ranges: list[dict]) -> DataFrame:
    """``label, n`` for each range from - to, both ends in; ranges may overlap and be empty."""
    if not ranges:
        return docs.sparkSession.createDataFrame([], "label string, n long")

    def inside(r: dict) -> Column:
        c = lambda x: x.cast("double").between(float(r["from"]), float(r["to"]))
        hit = F.exists(f.column, c) if f.array else c(f.column)
        return F.coalesce(F.sum(F.when(hit, 1).otherwise(0)), F.lit(0)).cast("long")

    one = docs.agg(F.array(*[F.struct(F.lit(f"{label(r['from'])}-{label(r['to'])}").alias("label"), inside(r).alias("n")) for r in ranges]).alias("r"))
    return one.select(F.inline("r"))


def bool_facet(docs: DataFrame, f: Field, definition: dict) -> DataFrame:
    wanted = [w for w in ("true", "false") if definition.get(w, definition.get(w == "true", False))]
    sums = [F.struct(F.lit(w).alias("label"), F.coalesce(F.sum(F.when(F.col("value") == (w == "true"), 1).otherwise(0)), F.lit(0)).cast("long").alias("n")) for w in wanted]
    if not sums:
        return docs.sparkSession.createDataFrame([], "label string, n long")
    return _values(docs, f).agg(F.array(*sums).alias("r")).select(F.inline("r"))


def string_facet(everything: DataFrame, docs: DataFrame, f: Field) -> DataFrame:
    """Every value that any document has, with how many of ``docs`` have it, be it none."""
    known = _values(everything, f).select(F.col("value").alias("label")).distinct()
    n = _values(docs, f).groupBy(F.col("value").alias("label")).agg(F.count("*").alias("n"))
    return known.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def facet(indexes: list[tuple[Index, DataFrame]], path: str, definition: dict) -> DataFrame:
    """``label, n`` over the (index, ``ord`` of its scored documents) that have the field."""
    out = []
    for index, scored in indexes:
        f = index.filters.get(path)
        if f is None:
            continue
        docs = index.docs.join(scored.select("ord"), "ord", "left_semi")
        if f.kind == "number" and "ranges" in definition:
            out.append(number_facet(docs, f, definition["ranges"]))
        elif f.kind == "bool" and ("true" in definition or "false" in definition):
            out.append(bool_facet(docs, f, definition))
        elif f.kind == "string" and not definition:
            out.append(string_facet(index.docs, docs, f))
        else:
            raise InvalidFacet(f"no facet {definition} on the {f.kind} field {path}")
    return reduce(DataFrame.unionByName, out).groupBy("label").agg(F.sum("n").alias("n"))


def _key_text(f: Field, k: str) -> Column:
    """A group's value as text; whole numbers without a fraction."""
    v = F.col(k)
    return F.when(v == F.floor(v), v.cast("decimal(38,0)").cast("string")).otherwise(v.cast("string")) if f.kind == "number" else v.cast("string")


def group_keys(index: Index, properties: list[str], ids: list[str]) -> DataFrame:
    """``id, ord, values`` of a few documents: the groups each is in."""
    fields = [index.filters.get(p) for p in properties]
    if None in fields:
        return index.docs.select("id", "ord", F.array().cast("array<string>").alias("values")).limit(0)
    docs = index.docs.where(F.col("id").isin(ids)).select("id", "ord", *[(f.column if f.array or f.kind != "number" else f.column.cast("double")).alias(f"k{i}") for i, f in enumerate(fields)])
    for i, f in enumerate(fields):
        if f.array:
            docs = docs.withColumn(f"k{i}", F.explode(F.array_distinct(f"k{i}")))
    return docs.select("id", "ord", F.array(*[_key_text(f, f"k{i}") for i, f in enumerate(fields)]).alias("values"))


def groups(parts: list[tuple[Index, DataFrame]], properties: list[str], most: int = 1, sort: tuple[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """``values, n, result``: every combination of the properties' known values, the empty
    ones too, the number of scored documents in it and its ``most`` best as
    (index_id, id, ord, score), by score or ``sort``.

    ``limit``: combinations beyond which the request is refused; there is none unless given.
    """
    keys = [f"k{i}" for i in range(len(properties))]
    rows, spaces = [], []
    for index, scored in parts:
        fields = [index.filters.get(p) for p in properties]
        if None in fields:
            continue
        for f in fields:
            if f.kind not in ("bool", "number", "string"):
                raise InvalidGroupField(f"can't group by the {f.kind} field {f.path}")
        text = [_key_text(f, k) for k, f in zip(keys, fields)]
        extra: list[Column] = []
        if sort and sort[0] in index.filters:
            extra = [index.filters[sort[0]].column.cast("double").alias("sort_key")]
        docs = index.docs.select("ord", "id", *extra, *[f.column.alias(k) if not f.array else F.array_distinct(f.column).alias(k) for k, f in zip(keys, fields)])
        for k, f in zip(keys, fields):
            if f.array:
                docs = docs.withColumn(k, F.explode(k))
            elif f.kind == "number":
                docs = docs.withColumn(k, F.col(k).cast("double"))
        space = None
        for k, x in zip(keys, text):
            one = docs.select(x.alias(k)).where(f"{k} is not null").distinct()
            space = one if space is None else space.crossJoin(one)
        spaces.append(space)
        member = docs.join(scored, "ord").select("ord", "id", "score", *(["sort_key"] if extra else [F.lit(None).cast("double").alias("sort_key")]), *[x.alias(k) for k, x in zip(keys, text)])
        rows.append(member.withColumn("index_id", F.lit(index.name)))
    space = reduce(DataFrame.unionByName, spaces).distinct()
    if limit is not None and (n := space.count()) > limit:
        raise InvalidGroupField(f"{n} groups are over the limit of {limit}")
    by = [F.round("score", 6).desc(), F.asc("ord"), F.asc("index_id")]
    members = reduce(DataFrame.unionByName, rows)
    if sort:
        by = [F.asc_nulls_last("sort_key") if sort[1] == "ASC" else F.desc_nulls_last("sort_key"), F.asc("ord"), F.asc("index_id")]
    w = Window.partitionBy(*keys)
    ranked = members.withColumn("r", F.row_number().over(w.orderBy(*by))).withColumn("n", F.count("*").over(w)).where(F.col("r") <= most)
    best = ranked.groupBy(*keys).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("r", "index_id", "id", "ord", "score"))).alias("result"))
    joined = space.join(best, keys, "left")
    empty = F.array().cast("array<struct<index_id:string,id:string,ord:bigint,score:double>>")
    plain = F.transform("result", lambda x: F.struct(x["index_id"].alias("index_id"), x["id"].alias("id"), x["ord"].alias("ord"), x["score"].alias("score")))
    return joined.select(F.array(*keys).alias("values"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(plain, empty).alias("result"))

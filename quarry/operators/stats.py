"""What an index holds, field by field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.index import Field, Index

COLUMNS = "field string, kind string, n long, n_true long, n_false long, keys long, low double, high double, average_length double"


def field_stats(index: Index) -> DataFrame:
    """A row a field and kind: documents that have it; values true and false; distinct values;
    least and greatest number; for texts distinct terms and average length; for vectors how
    many there are."""
    null = lambda t: F.lit(None).cast(t)

    def row(df: DataFrame, path: str, kind: str, n=None, true=None, false=None, keys=None, low=None, high=None, average=None) -> DataFrame:
        return df.agg((F.count("*") if n is None else n).cast("long").alias("n"), *[(null(t) if c is None else c.cast(t)).alias(k) for k, t, c in (("n_true", "long", true), ("n_false", "long", false), ("keys", "long", keys), ("low", "double", low), ("high", "double", high), ("average_length", "double", average))]).select(F.lit(path).alias("field"), F.lit(kind).alias("kind"), "n", "n_true", "n_false", "keys", "low", "high", "average_length")

    # Plain fields without distinct values are columns of one aggregate over the documents.
    plain = [f for f in index.filters.values() if not f.array and f.kind != "string"]
    out = [_plain(index, plain)] if plain else []
    for f in index.filters.values():
        if f in plain:
            continue
        docs = index.docs.select("ord", f.column.alias("v")).where("v is not null")
        n = F.count("*")
        if f.array:
            docs = docs.select("ord", F.explode("v").alias("v")).where("v is not null")
            n = F.count_distinct("ord")
        if f.kind == "bool":
            out.append(row(docs, f.path, f.kind, n, F.count_if("v"), F.count_if(~F.col("v"))))
        elif f.kind == "number":
            out.append(row(docs, f.path, f.kind, n, low=F.min("v"), high=F.max("v")))
        else:
            out.append(row(docs, f.path, f.kind, n, keys=F.count_distinct("v")))
    for path in index.texts:
        terms = index.vocabulary().where(F.col("field") == path).agg(F.count("*").alias("terms"))
        size = index.lengths.where(F.col("field") == path).crossJoin(terms)
        out.append(row(size, path, "text", keys=F.first("terms"), average=F.avg("len")))
    for path, rows in index.vector_rows().items():
        out.append(row(rows.where("embedding is not null"), path, "vector"))
    return reduce(DataFrame.unionByName, out)


def _plain(index: Index, fields: list[Field]) -> DataFrame:
    def stats(f: Field) -> Column:
        c, none = f.column, F.lit(None)
        true, false = (F.count_if(c), F.count_if(~c)) if f.kind == "bool" else (none, none)
        low, high = (F.min(c), F.max(c)) if f.kind == "number" else (none, none)
        values = {"field": F.lit(f.path), "kind": F.lit(f.kind), "n": F.count(c), "n_true": true.cast("long"), "n_false": false.cast("long"), "keys": none.cast("long"), "low": low.cast("double"), "high": high.cast("double"), "average_length": none.cast("double")}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    return index.docs.agg(F.array(*[stats(f) for f in fields]).alias("r")).select(F.inline("r"))


def filterable_fields(index: Index) -> DataFrame:
    """:func:`field_stats` of the fields that filters can use."""
    return field_stats(index).where("kind in ('bool', 'number', 'date', 'string', 'geo')")

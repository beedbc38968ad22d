"""An index: documents, the types of their fields, and the tables that searches read."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import filesystem, ship
from ..functions import dates
from ..functions.documents import json_path, leaves
from ..functions.text import ENGLISH, begins, explicit_enum, has_tokens, length_gate, stem_expr, tokens

#: Fields that are never searched.
RESERVED = ("id", "_omc")
POSTINGS = "field string, ord long, term string, tf long, len int, stemmed boolean"
LENGTHS = "field string, ord long, len int"
#: Shapes of documents that a worker remembers; when there are more, it begins anew and parses some again.
MAX_SHAPES = 10_000


@dataclass(frozen=True)
class Field:
    """kind: bool, number, date, string, geo (filters), text or vector (scores).

    raw, admits: the column that a string's values are taken from, and whether a value is kept;
    integral: a number column of whole numbers; whole: its whole numbers, null for others.
    """

    path: str
    kind: str
    array: bool
    column: Column
    raw: Column | None = None
    admits: Callable[[str], bool] | None = None
    integral: bool = False
    whole: Column | None = None


@dataclass
class Strategy:
    """Which strings are kept as values to filter by: from 1 to ``longest`` bytes, or only
    those written as enum('x')."""

    longest: int = 25
    explicit: bool = False

    def apply(self, value: Column) -> Column:
        return explicit_enum(value) if self.explicit else length_gate(value, 1, self.longest)

    def field(self, path: str, array: bool, value: Column) -> Field:
        """A string field; where it is plain, equality can be asked of the column itself."""
        kept = F.transform(value, self.apply) if array else self.apply(value)
        if array or self.explicit:
            return Field(path, "string", array, kept)
        return Field(path, "string", False, kept, value, lambda x: 1 <= len(x.encode()) <= self.longest)


@dataclass
class Index:
    """docs: a row a document with ``ord`` (its place, which breaks ties), ``id`` and the
    columns that the fields refer to. Postings, lengths and statistics derive from it;
    :meth:`write` makes them tables, sorted by term so that a search reads only the row
    groups of its terms. vector_tables: ``ord, embedding`` by name, a row a vector."""

    name: str
    docs: DataFrame
    filters: dict[str, Field]
    texts: dict[str, Field]
    vectors: dict[str, Field] = field(default_factory=dict)
    multiplier: Column | None = None
    body: Column | None = None
    language: str = ENGLISH
    postings_table: DataFrame | None = None
    lengths_table: DataFrame | None = None
    vector_tables: dict[str, DataFrame] = field(default_factory=dict)
    known: dict | None = None

    @cached_property
    def count(self) -> int:
        return self.known["count"] if self.known else self.docs.count()

    @cached_property
    def postings(self) -> DataFrame:
        """field, ord, term, tf, len, stemmed: how often a term is in a field of ``len`` tokens,
        and in rows of their own (stemmed) how often words are that have it as their stem."""
        if self.postings_table is not None:
            return self.postings_table
        if not self.texts:
            return self.docs.sparkSession.createDataFrame([], POSTINGS)
        out = self._words(list(self.texts)).groupBy("field", "ord", "word").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
        stem = stem_expr(F.col("word"), self.language)
        both = F.array(F.struct(F.col("word").alias("term"), F.lit(False).alias("stemmed")), F.when(stem != F.col("word"), F.struct(stem.alias("term"), F.lit(True).alias("stemmed"))))
        rows = out.select("field", "ord", "tf", "len", F.explode(F.array_compact(both)).alias("t")).select("field", "ord", "t.term", "tf", "len", "t.stemmed")
        # Words of one stem are few; plain rows need no sum, so only the others are grouped.
        plain, stems = rows.where("not stemmed"), rows.where("stemmed").groupBy("field", "ord", "term").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"), F.lit(True).alias("stemmed"))
        return plain.unionByName(stems)

    def _tokens(self, path: str) -> DataFrame:
        """field, ord, w, len: the tokens of each text of a field."""
        return self.docs.select(F.lit(path).alias("field"), "ord", self._split(path).alias("w")).withColumn("len", F.size("w"))

    def _split(self, path: str) -> Column:
        f = self.texts[path]
        return F.flatten(F.transform(F.array_compact(f.column), tokens)) if f.array else tokens(f.column)

    def _words(self, fields: list[str]) -> DataFrame:
        """field, ord, len, word: a row an occurrence. Outer, as Spark would otherwise ask first
        whether there are tokens and so make them anew for each question."""
        parts = [self._tokens(p).select("field", "ord", "len", F.explode_outer("w").alias("word")) for p in fields]
        return reduce(DataFrame.unionByName, parts).where("word is not null")

    def hits(self, fields: list[str], keep: Callable[[str], Column], likely: Callable[[str], Column], stems: bool) -> DataFrame:
        """Of the :attr:`postings` of ``fields``, those with a term that ``keep``, given the name of
        its column, takes; with ``stems`` those of stems too. Where no postings are written, words
        are chosen as they are read and not grouped: a row an occurrence, to be summed by
        document. likely: what words pass that have themselves or their stem taken."""
        if self.postings_table is not None or not fields:
            rows = self.postings.where(F.col("field").isin(fields)).where(keep("term"))
            return rows if stems else rows.where("not stemmed")
        one = F.lit(1).cast("long").alias("tf")
        words = self._words(fields)
        if not stems:
            return words.where(keep("word")).select("field", "ord", F.col("word").alias("term"), one, "len", F.lit(False).alias("stemmed"))
        # A stem is an array's only item so that it is made once, not for each question about it.
        both = words.where(likely("word")).select("*", F.explode_outer(F.array(stem_expr(F.col("word"), self.language))).alias("stem")).where(keep("word") | keep("stem"))
        terms = F.array(F.struct(F.col("word").alias("term"), F.lit(False).alias("stemmed")), F.when(F.col("stem") != F.col("word"), F.struct(F.col("stem").alias("term"), F.lit(True).alias("stemmed"))))
        return both.select("field", "ord", "len", F.explode(F.array_compact(terms)).alias("t")).select("field", "ord", "t.term", one, "len", "t.stemmed").where(keep("term"))

    @cached_property
    def lengths(self) -> DataFrame:
        """field, ord, len of each text that has a token."""
        if self.lengths_table is not None:
            return self.lengths_table
        out = None
        for f in self.texts.values():
            if f.array:
                n, some = F.size(F.flatten(F.transform(F.array_compact(f.column), tokens))), F.exists(f.column, has_tokens)
            else:
                n, some = F.size(tokens(f.column)), has_tokens(f.column)
            t = self.docs.where(some).select(F.lit(f.path).alias("field"), "ord", n.alias("len"))
            out = t if out is None else out.unionByName(t)
        return self.docs.sparkSession.createDataFrame([], LENGTHS) if out is None else out

    @cached_property
    def average_lengths(self) -> dict[str, float]:
        if self.known:
            return {k: total / n for k, (n, total) in self.known["lengths"].items() if n}
        return {r[0]: float(r[1]) for r in self.lengths.groupBy("field").agg(F.avg("len")).collect()}  # a row a field

    def vocabulary(self) -> DataFrame:
        """field, term, df, n: how many documents have a term, and how often it occurs. Where each
        document is one row, its tokens and its distinct ones are counted as they are read; only
        else must the rows of a document meet."""
        if self.postings_table is not None or not self.texts or not self.unique:
            return self.postings.where("not stemmed").groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
        parts = [self._tokens(p).select("field", "len", F.posexplode_outer(F.concat("w", F.array_distinct("w"))).alias("at", "term")) for p in self.texts]
        rows = reduce(DataFrame.unionByName, parts).where("term is not null")
        return rows.groupBy("field", "term").agg(F.count_if(F.col("at") >= F.col("len")).alias("df"), F.count_if(F.col("at") < F.col("len")).alias("n"))

    @cached_property
    def unique(self) -> bool:
        """Whether no two rows have one ``ord``."""
        return self.docs.groupBy("ord").count().where("count > 1").isEmpty()

    def vector_rows(self) -> dict[str, DataFrame]:
        """``ord, embedding`` of each vector field."""
        return {**{f.path: self.docs.select("ord", f.column.alias("embedding")) for f in self.vectors.values()}, **self.vector_tables}

    def write_postings(self, path: str) -> None:
        """Where each document is one row, its terms are counted as it is read, once, and written
        as they come; lengths and sorted postings are made of that. Only else must rows meet."""
        if self.postings_table is not None or not self.texts or not self.unique:
            by_term(self.postings).write.mode("overwrite").parquet(f"{path}/postings")
            self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
            return
        self._terms().write.mode("overwrite").parquet(f"{path}/terms")
        terms = self.docs.sparkSession.read.schema(f"{POSTINGS}, opens boolean").parquet(f"{path}/terms")
        by_term(terms.drop("opens")).write.mode("overwrite").parquet(f"{path}/postings")
        terms.where("opens").select("field", "ord", "len").write.mode("overwrite").parquet(f"{path}/lengths")
        fs, at = filesystem(f"{path}/terms")
        fs.delete_dir(at)

    def _terms(self) -> DataFrame:
        """The :attr:`postings` of documents that are one row each, and with ``opens`` a row for each
        text that has a token."""
        words = [F.struct(F.lit(p).alias("field"), self._split(p).alias("w")) for p in self.texts]
        rows = self.docs.select("ord", F.explode_outer(F.array(*words)).alias("t")).select("ord", "t.field", "t.w").where(F.size("w") > 0)
        stems = F.array_compact(F.zip_with("w", F.transform("w", lambda t: stem_expr(t, self.language)), lambda t, s: F.when(t != s, s)))
        rows = rows.select("field", "ord", F.size("w").alias("len"), F.sort_array("w").alias("w"), F.sort_array(stems).alias("s"))
        rows = rows.withColumns({"w_at": begins(F.col("w")), "s_at": begins(F.col("s"))})
        # A run of equal words, then of equal stems, a row; it ends where the next one begins.
        rows = rows.select("*", F.posexplode_outer(F.concat("w_at", "s_at")).alias("k", "at"))
        n = F.size("w_at")

        def of(words: Column, stems: Column) -> Column:
            return F.when(F.col("k") < n, words).otherwise(stems)

        end = of(F.coalesce(F.get("w_at", F.col("k") + 1), F.size("w")), F.coalesce(F.get("s_at", F.col("k") - n + 1), F.size("s")))
        return rows.select("field", "ord", of(F.get("w", "at"), F.get("s", "at")).alias("term"), (end - F.col("at")).cast("long").alias("tf"), "len", (F.col("k") >= n).alias("stemmed"), (F.col("k") == 0).alias("opens"))

    def write(self, path: str) -> Index:
        """The same index on written tables."""
        spark = self.docs.sparkSession
        self.write_postings(path)
        return replace(self, postings_table=spark.read.schema(POSTINGS).parquet(f"{path}/postings"), lengths_table=spark.read.schema(LENGTHS).parquet(f"{path}/lengths"))


def by_term(postings: DataFrame) -> DataFrame:
    """Postings in the order that searches read, split by all of it: a term of most documents is
    no one task's."""
    return postings.repartitionByRange("term", "field", "ord").sortWithinPartitions("term", "field", "ord")


def _walk(schema: T.StructType, prefix: str = "") -> Iterator[tuple[str, T.DataType]]:
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType) and {x.lower() for x in f.dataType.names} != {"lat", "lon"}:
            yield from _walk(f.dataType, f"{prefix}{f.name}.")
        else:
            yield f"{prefix}{f.name}", f.dataType


def kind_of(t: T.DataType) -> str | None:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.StructType):
        return "geo"
    return None


def _at(path: str) -> Column:
    parts = path.split(".")
    out = F.col(f"`{parts[0]}`")
    for p in parts[1:]:
        out = out[p]
    return out


def from_table(name: str, df: DataFrame, key: str, order: str | None = None, texts: list[str] | None = None, strategy: Strategy | None = None, multiplier: str | None = None, language: str = ENGLISH) -> Index:
    """An index over a typed table. key: the id; order: a column of whole numbers that says
    in which order documents came, the key unless given. texts: string columns to search,
    all unless given. Arrays of floats are vectors."""
    strategy = strategy or Strategy()
    docs = df.withColumns({"ord": F.col(order or key).cast("long"), "id": F.col(key).cast("string")})
    filters, text_fields, vectors = {}, {}, {}
    for path, t in _walk(df.schema):
        if path in (*RESERVED, multiplier):
            continue
        array = isinstance(t, T.ArrayType)
        inner = t.elementType if array else t
        column = _at(path)
        if array and isinstance(inner, T.FloatType):
            vectors[path] = Field(path, "vector", True, column)
            continue
        kind = kind_of(inner)
        if kind is None or (array and kind in ("geo", "date")):
            continue
        if kind == "string":
            filters[path] = strategy.field(path, array, column)
            if texts is None or path in texts:
                text_fields[path] = Field(path, "text", array, column)
        else:
            filters[path] = Field(path, kind, array, column, integral=isinstance(inner, T.IntegralType))
    return Index(name, docs, filters, text_fields, vectors, F.col(multiplier).cast("double") if multiplier else None, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), language)


def infer_kind(value) -> str | None:
    """The type of a JSON value: bool, number, date, string, geo, or one of them with [] for an
    array, by its first element that isn't null."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "date" if dates.parse(value) is not None else "string"
    if isinstance(value, dict):
        return "geo"
    if isinstance(value, list):
        first = next((x for x in value if x is not None), None)
        inner = None if isinstance(first, (dict, list)) else infer_kind(first)
        return f"{'string' if inner == 'date' else inner}[]" if inner else None
    return None


def infer_schema(docs: DataFrame) -> dict[str, str]:
    """Path to kind of JSON documents (``ord``, ``body``); the first document that has a path
    decides. Each partition finds its own firsts; the least of them is taken. Of documents of one
    shape the first decides for all, so later ones aren't parsed in Python, but for shapes that
    don't tell what an array begins with."""
    ship(docs.sparkSession)
    shape = F.col("shape")
    # Only keys in backticks could look like a decimal, of which there would be a shape for each precision.
    alike = F.when(shape.contains("`"), shape).otherwise(F.regexp_replace(shape, r"DECIMAL\(\d+, ?\d+\)", "DOUBLE"))
    shaped = docs.select("ord", "body", F.schema_of_variant(F.try_parse_json("body")).alias("shape")).select("ord", "body", F.when(~shape.contains("VARIANT"), alike).alias("shape"))

    def run(batches):
        first: dict[str, tuple[int, str]] = {}
        least: dict[str, int] = {}
        for pdf in batches:
            for at, shape, body in zip(pdf["ord"], pdf["shape"], pdf["body"]):
                if isinstance(shape, str):
                    if shape in least and least[shape] <= at:
                        continue
                    if len(least) >= MAX_SHAPES:
                        least.clear()
                    least[shape] = at
                for path, value in leaves(json.loads(body)):
                    kind = infer_kind(value)
                    if kind and (path not in first or at < first[path][0]):
                        first[path] = (at, kind)
        yield pd.DataFrame([(p, int(o), k) for p, (o, k) in first.items()], columns=["path", "ord", "kind"])

    found = shaped.mapInPandas(run, "path string, ord long, kind string")
    return {r[0]: r[1] for r in found.groupBy("path").agg(F.min_by("kind", "ord")).collect()}  # a row a path


_JSON_TYPES = {"bool": ("boolean", "BOOLEAN"), "number": ("double", "BIGINT|DOUBLE|DECIMAL"), "string": ("string", "STRING"), "date": ("string", "STRING")}


def typed_columns(schema: dict[str, str]) -> dict[str, str]:
    """The columns of :func:`typed` and their types. Columns are numbered in the order that paths
    came in, so that later paths never change those of earlier ones."""
    out = {}
    for i, (path, kind) in enumerate(schema.items()):
        if path in RESERVED:
            continue
        plain = kind.removesuffix("[]")
        if plain == "geo":
            out[f"f{i}"] = "struct<lat:double,lon:double>"
            continue
        out[f"f{i}"] = f"array<{_JSON_TYPES[plain][0]}>" if kind.endswith("[]") else _JSON_TYPES[plain][0]
        if kind == "number":
            out[f"w{i}"] = "bigint"
        elif kind == "date":
            out[f"d{i}"] = "timestamp"
    return {**out, "_omc": "double"}


def typed(docs: DataFrame, schema: dict[str, str], body: str = "body") -> DataFrame:
    """``docs`` with a column f0, f1, ... for each path of its JSON ``body``, a w0, ... for the
    whole numbers among numbers, a d0, ... for the moments of dates, and ``_omc``. A value of
    another type than its path has counts as missing."""
    columns = {}

    def got(path: str, kind: str, inner: str = ""):
        # nested objects, else one key with dots, as flat documents have it
        places = [json_path(path), *(["$['" + path.replace("'", "\\'") + "']"] if "." in path else [])]
        return F.coalesce(*[F.try_variant_get("v", p + inner, kind) for p in places])

    for i, (path, kind) in enumerate(schema.items()):
        if path in RESERVED:
            continue
        array = kind.endswith("[]")
        kind = kind.removesuffix("[]")
        if kind == "geo":
            lat, lon = (got(path, "double", f"['{k}']") for k in ("lat", "lon"))
            columns[f"f{i}"] = F.when(lat.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))
            continue
        t, names = _JSON_TYPES[kind]
        shape = F.schema_of_variant(got(path, "variant"))
        if array:
            columns[f"f{i}"] = F.when(shape.rlike(f"^ARRAY<({names})"), got(path, f"array<{t}>"))
            continue
        value = F.when(shape.rlike(f"^({names})"), got(path, t))
        columns[f"f{i}"] = value
        if kind == "number":
            columns[f"w{i}"] = F.when(shape == "BIGINT", got(path, "bigint"))
        elif kind == "date":
            columns[f"d{i}"] = dates.lenient(value)
    omc = F.try_variant_get("v", "$['_omc']", "double")
    return docs.withColumn("v", F.parse_json(body)).withColumns({**columns, "_omc": F.when(omc > 0, omc)}).drop("v")


def typed_index(name: str, rows: DataFrame, schema: dict[str, str], strategy: Strategy | None = None, language: str = ENGLISH, **tables) -> Index:
    """An index over what :func:`typed` makes."""
    strategy = strategy or Strategy()
    filters, texts = {}, {}
    for i, (path, kind) in enumerate(schema.items()):
        if path in RESERVED:
            continue
        array = kind.endswith("[]")
        kind = kind.removesuffix("[]")
        value = F.col(f"f{i}")
        if kind == "date":
            filters[path] = Field(path, "date", False, F.col(f"d{i}"))
        elif kind == "string":
            filters[path] = strategy.field(path, array, value)
        else:
            filters[path] = Field(path, kind, array, value, whole=F.col(f"w{i}") if kind == "number" and not array else None)
        if kind in ("string", "date"):
            texts[path] = Field(path, "text", array, value)
    return Index(name, rows, filters, texts, {}, F.col("_omc"), F.col("body"), language, **tables)


def from_json(name: str, docs: DataFrame, strategy: Strategy | None = None, schema: dict[str, str] | None = None, language: str = ENGLISH) -> Index:
    """An index over JSON documents: ``ord`` long, ``id`` string, ``body`` string."""
    schema = dict(sorted(infer_schema(docs).items())) if schema is None else schema
    return typed_index(name, typed(docs, schema), schema, strategy, language)

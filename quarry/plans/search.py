"""One search over the indexes of a collection."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import facets as facet_ops
from ..operators.ranking import PinRule, multiplied, place_pins, promotions, top
from ..operators.text_score import properties_of, text_scores
from ..operators.vector_score import fused, nearest
from ..sources.index import Index
from .params import FacetFieldNotFound, FilterFieldNotFound, InvalidSortField, Request, SearchError, SortFieldNotFound, UnknownIndex, where_keys
from .where import compile_where

#: Hits whose documents are asked for by literals.
PAGE_KEYS = 1000


@dataclass
class Context:
    """What searches of a collection use besides its indexes.

    encoder: text to vector. choose_mode: term to fulltext, vector or hybrid, for the auto
    mode. before_search and after_search: hooks; None returned leaves things as they were.
    rescale: whether similarities are spread (see vectors.rescaled). log: called with one
    record a search.
    """

    pins: list[PinRule] = field(default_factory=list)
    encoder: Callable[[str], list[float]] | None = None
    choose_mode: Callable[[str], str] | None = None
    before_search: Callable[[dict], dict | None] | None = None
    after_search: Callable[[list[dict]], list[dict] | None] | None = None
    rescale: bool = False
    log: Callable[[dict], None] | None = None


def heuristic_mode(term: str) -> str:
    """Questions and long phrases by meaning, few words by text, the others by both."""
    n = len(term.split())
    return "vector" if term.strip().endswith("?") or n > 7 else "fulltext" if n <= 2 else "hybrid"


def resolve_mode(request: Request, context: Context) -> str:
    if request.mode == "auto":
        mode = (context.choose_mode or heuristic_mode)(request.term)
        if mode not in ("fulltext", "vector", "hybrid"):
            raise SearchError(f"no mode {mode}")
        return mode
    return "fulltext" if request.mode == "default" else request.mode


def selected(indexes: dict[str, Index], names: list[str] | None) -> list[Index]:
    if not names:
        return list(indexes.values())
    for n in names:
        if n not in indexes:
            raise UnknownIndex(n)
    return [indexes[n] for n in names]


def score(index: Index, request: Request, mode: str, context: Context, filtered: bool = True) -> DataFrame:
    """``ord, score`` of an index; without its filter if ``filtered`` is false."""
    allowed = index.docs.where(compile_where(index, request.where)).select("ord") if filtered and request.where else None
    text = text_scores(index, request, allowed) if mode in ("fulltext", "hybrid") else None
    vector = None
    if mode in ("vector", "hybrid"):
        query = request.vector if request.vector is not None else context.encoder(request.term) if context.encoder else None
        if query is None:
            raise SearchError("a vector search needs a vector or an encoder")
        for rows in index.vector_rows().values():
            part = nearest(rows, query, request.limit + request.offset, request.similarity, context.rescale, allowed)
            vector = part if vector is None else vector.unionByName(part).groupBy("ord").agg(F.sum("score").alias("score"))
        if vector is None:
            vector = index.docs.select("ord", F.lit(0.0).alias("score")).limit(0)
    out = text if vector is None else vector if text is None else fused(text, vector)
    return multiplied(out, index.docs, index.multiplier)


@dataclass
class Plan:
    """The parts of an answer as DataFrames; nothing has run but small statistics. Scores are
    marked to be kept once computed where more than one part reads them; :meth:`close` ends that."""

    request: Request
    indexes: list[Index]
    scored: list[tuple[Index, DataFrame]]
    hits: DataFrame
    facets: dict[str, DataFrame]
    groups: DataFrame | None
    kept: list[DataFrame] = field(default_factory=list)

    def count(self) -> int:
        return sum(s.count() for _, s in self.scored)

    def page(self) -> tuple[int, list]:
        """(number of matches, the page's rows in order), from one pass over the scores."""
        if not self.request.limit or self.request.sort_by:
            return self.count(), self.hits.collect()  # at most ``limit`` rows
        seen = Observation()
        rows = self.ordered(_union(self.scored).observe(seen, F.count(F.lit(1)).alias("n"))).collect()
        return seen.get["n"], rows

    def ordered(self, rows: DataFrame) -> DataFrame:
        return top(rows, self.request.limit, self.request.offset, by_score()).select("index_id", "ord", "score")

    def close(self) -> None:
        for k in self.kept:
            k.unpersist()


def by_score() -> list:
    return [F.round("score", 6).desc(), F.asc("ord"), F.asc("index_id")]


def _union(scored: list[tuple[Index, DataFrame]], extra: str | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select("ord", "score", *([extra] if extra else [])).withColumn("index_id", F.lit(i.name)) for i, s in scored])


def _sort_key(scored: list[tuple[Index, DataFrame]], name: str) -> list[tuple[Index, DataFrame]]:
    known = [i.filters[name] for i, _ in scored if name in i.filters]
    if not known:
        raise SortFieldNotFound(name)
    for f in known:
        if f.kind not in ("number", "bool", "date") or f.array:
            raise InvalidSortField(name)
    out = []
    for i, s in scored:
        f = i.filters.get(name)
        if f is not None:
            c = F.unix_millis(f.column.cast("timestamp")).cast("double") if f.kind == "date" else f.column.cast("double")
            out.append((i, s.join(i.docs.select("ord", c.alias("sort_key")).where("sort_key is not null"), "ord")))
    return out


def plan(indexes: dict[str, Index], request: Request, context: Context | None = None, keep: bool = False) -> Plan:
    """Scores, then the page's hits in order, facets (over the matches regardless of the
    filter) and groups. Hits carry index_id, ord, score. keep: whether scores that several
    parts read are kept (in memory or on disk, as Spark sees fit) until the plan is closed."""
    context = context or Context()
    chosen = selected(indexes, request.indexes)
    mode = resolve_mode(request, context)
    scored = [(i, score(i, request, mode, context)) for i in chosen]
    kept = []
    if keep:
        scored = [(i, s.persist()) for i, s in scored]
        kept = [s for _, s in scored]
    if request.sort_by:
        name, order = request.sort_by
        rows = _union(_sort_key(scored, name), "sort_key")
        by = [F.col("sort_key").asc() if order == "ASC" else F.col("sort_key").desc(), F.asc("ord"), F.asc("index_id")]
    else:
        rows, by = _union(scored), by_score()
    hits = top(rows, request.limit, request.offset, by).select("index_id", "ord", "score")
    facets = {}
    if request.facets:
        base = scored
        if request.where:
            base = [(i, score(i, request, mode, context, False)) for i in chosen]
            if keep and len(request.facets) > 1:
                base = [(i, s.persist()) for i, s in base]
                kept += [s for _, s in base]
        for name, definition in request.facets.items():
            if not any(name in i.filters for i in chosen):
                raise FacetFieldNotFound(name)
            facets[name] = facet_ops.facet(base, name, definition)
    groups = facet_ops.groups(scored, request.group_by, request.group_max, request.group_sort or request.sort_by) if request.group_by else None
    return Plan(request, chosen, scored, hits, facets, groups, kept)


def _bodies(index: Index) -> DataFrame:
    return index.docs.select(F.lit(index.name).alias("index_id"), "ord", "id", index.body.alias("document") if index.body is not None else F.lit(None).cast("string").alias("document"))


def with_documents(hits: list, indexes: list[Index]) -> DataFrame:
    """Ids and bodies of a page's hits (rows with index_id and ord). Their places reach the scans as
    literals, up to PAGE_KEYS of them; larger pages are joined."""
    parts = []
    for index in indexes:
        ords = [r["ord"] for r in hits if r["index_id"] == index.name]
        if not ords:
            continue
        if len(ords) <= PAGE_KEYS:
            parts.append(_bodies(index).where(F.col("ord").isin(ords)))
        else:
            keys = index.docs.sparkSession.createDataFrame([(o,) for o in ords], "ord long")
            parts.append(_bodies(index).where(F.col("ord").between(min(ords), max(ords))).join(keys, "ord", "left_semi"))
    return reduce(DataFrame.unionByName, parts) if parts else _bodies(indexes[0]).limit(0)


def search(indexes: dict[str, Index], json_request: dict, context: Context | None = None) -> dict:
    """The answer as plain values: {count, hits: [{id, index_id, score, document}], facets,
    groups}. Only the page itself reaches the driver."""
    context = context or Context()
    if context.before_search:
        json_request = context.before_search(json_request) or json_request
    request = Request.of(json_request)
    pins = promotions(context.pins, request.term)
    asked, size = request, request.limit + request.offset
    if pins:
        request = Request(**{**request.__dict__, "limit": 2 * size, "offset": 0, "group_max": 2 * request.group_max})
    several = bool(pins or request.group_by or request.sort_by or (request.facets and not request.where))
    p = plan(indexes, request, context, several)
    try:
        return _answer(p, asked, pins, context)
    finally:
        p.close()


def _answer(p: Plan, asked: Request, pins: list[tuple[str, int]], context: Context) -> dict:
    request, size = p.request, asked.limit + asked.offset
    count, order = p.page()
    if not count and request.where:
        for k in where_keys(request.where):
            if not any(k in i.filters for i in p.indexes):
                raise FilterFieldNotFound(k)
    at = {(r["index_id"], r["ord"]): r for r in with_documents(order, p.indexes).collect()} if order else {}  # a row a hit
    hits = [{"id": f"{r['index_id']}:{at[r['index_id'], r['ord']]['id']}", "index_id": r["index_id"], "score": r["score"], "document": json.loads(at[r["index_id"], r["ord"]]["document"] or "null")} for r in order]
    extra = _pinned(p, dict(pins)) if pins else []
    if pins:
        hits = place_pins(hits, extra, lambda h: h["id"])[asked.offset : size]
    if context.after_search:
        docs = context.after_search([h["document"] for h in hits])
        if docs is not None:
            by_id = {str(d.get("id")): d for d in docs}
            hits = [{**h, "document": by_id[h["id"].split(":", 1)[1]]} for h in hits if h["id"].split(":", 1)[1] in by_id]
            count = len(hits)
    out: dict = {"count": count, "hits": hits, "facets": {}}
    if asked.metrics:
        total = sum(i.count for i in p.indexes)
        out["metrics"] = {"matched": count, "total": total, "share": count / total if total else 0.0}
    for name, df in p.facets.items():
        values = {r["label"]: r["n"] for r in df.collect()}  # a row a value
        out["facets"][name] = {"count": len(values), "values": values}
    if p.groups is not None:
        inside: dict[tuple, list] = {}
        for h, position in extra:
            inside.setdefault((h["index_id"], h["id"].split(":", 1)[1]), []).append((h, position))
        members = [(tuple(r["values"]), h, position) for i in p.indexes if pins for r in facet_ops.group_keys(i, request.group_by, list(dict(pins))).collect() for h, position in inside.get((i.name, r["id"]), [])]
        out["groups"] = []
        for r in p.groups.orderBy("values").collect():  # a row a group
            found = [{"id": f"{x['index_id']}:{x['id']}", "index_id": x["index_id"], "score": x["score"]} for x in r["result"]]
            own = [({k: h[k] for k in ("id", "index_id", "score")}, position) for v, h, position in members if v == tuple(r["values"])]
            out["groups"].append({"values": list(r["values"]), "result": place_pins(found, own, lambda h: h["id"])[: asked.group_max]})
    if context.log:
        context.log({"term": request.term, "mode": request.mode, "count": count, "has_filters": bool(request.where), "has_groups": bool(request.group_by), "has_sort": bool(request.sort_by), "user_id": request.user_id})
    return out


def _pinned(p: Plan, pins: dict[str, int]) -> list[tuple[dict, int]]:
    """Pinned documents that exist, matching or not, with their score (0 if none)."""
    out = []
    for index, scored in p.scored:
        found = index.docs.where(F.col("id").isin(list(pins))).select("ord", "id", index.body.alias("document") if index.body is not None else F.lit(None).cast("string").alias("document"))
        rows = found.join(scored, "ord", "left").collect()  # as many as pins
        out += [({"id": f"{index.name}:{r['id']}", "index_id": index.name, "score": r["score"] or 0.0, "document": json.loads(r["document"] or "null")}, pins[r["id"]]) for r in rows]
    return out


def fields_searched(indexes: dict[str, Index], request: Request) -> dict[str, list[str]]:
    return {i.name: properties_of(i, request.properties) for i in selected(indexes, request.indexes)}

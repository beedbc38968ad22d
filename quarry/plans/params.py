"""The search request and the errors it can cause."""

from __future__ import annotations

from dataclasses import dataclass, field


class SearchError(ValueError):
    """A request that can't be answered."""


class FilterFieldNotFound(SearchError):
    pass


class FacetFieldNotFound(SearchError):
    pass


class SortFieldNotFound(SearchError):
    pass


class InvalidSortField(SearchError):
    pass


class InvalidFacet(SearchError):
    pass


class InvalidGroupField(SearchError):
    pass


class UnknownIndex(SearchError):
    pass


class WriteError(ValueError):
    """A change that was refused."""


MODES = ("fulltext", "vector", "hybrid", "auto", "default")


def _unit(name: str, value):
    if value is not None and not (isinstance(value, (int, float)) and not isinstance(value, bool) and 0 <= value <= 1):
        raise SearchError(f"{name} must be from 0 to 1")
    return value


@dataclass
class Request:
    """One search; names and defaults as in :meth:`of`'s JSON."""

    term: str
    mode: str = "default"
    exact: bool = False
    tolerance: int | None = None
    threshold: float | None = None
    similarity: float = 0.7
    limit: int = 10
    offset: int = 0
    boost: dict[str, float] = field(default_factory=dict)
    properties: list[str] | None = None
    where: dict = field(default_factory=dict)
    facets: dict[str, dict] = field(default_factory=dict)
    indexes: list[str] | None = None
    sort_by: tuple[str, str] | None = None
    group_by: list[str] | None = None
    group_max: int = 1
    group_sort: tuple[str, str] | None = None
    user_id: str | None = None
    vector: list[float] | None = None
    metrics: bool = False

    @classmethod
    def of(cls, json: dict) -> Request:
        if "term" not in json:
            raise SearchError("term is missing")
        mode = json.get("mode") or "default"
        if mode not in MODES:
            raise SearchError(f"no mode {mode}")
        props = json.get("properties")
        if props in (None, "*"):
            props = None
        elif not isinstance(props, list):
            raise SearchError("properties must be a list or *")
        sort = json.get("sortBy")
        if sort:
            order = sort.get("order", "ASC")
            if order not in ("ASC", "DESC"):
                raise SearchError(f"no order {order}")
            sort = (sort["property"], order)
        group = json.get("groupBy") or {}
        for k in ("limit", "offset", "tolerance"):
            if json.get(k) is not None and (not isinstance(json[k], int) or isinstance(json[k], bool) or json[k] < 0):
                raise SearchError(f"{k} must be a whole number")
        return cls(
            term=json["term"], mode=mode, exact=bool(json.get("exact", False)), tolerance=json.get("tolerance"),
            threshold=_unit("threshold", json.get("threshold")), similarity=_unit("similarity", json.get("similarity", 0.7)),
            limit=json.get("limit", 10), offset=json.get("offset", 0), boost=dict(json.get("boost") or {}), properties=props,
            where=dict(json.get("where") or {}), facets=dict(json.get("facets") or {}), indexes=list(json.get("indexes") or []) or None,
            sort_by=sort or None, group_by=list(group["properties"]) if group else None, group_max=group.get("max_results", 1),
            user_id=json.get("userID"), vector=json.get("vector"), metrics=bool(json.get("metrics", False)),
        )


def where_pairs(where: dict) -> list[tuple[str, object]]:
    """All (field, filter) of a filter and those inside of it."""
    out = [(k, v) for k, v in where.items() if k not in ("and", "or", "not")]
    for k in ("and", "or"):
        for x in where.get(k) or []:
            out += where_pairs(x)
    return out + (where_pairs(where["not"]) if where.get("not") is not None else [])


def where_keys(where: dict) -> list[str]:
    return [k for k, _ in where_pairs(where)]

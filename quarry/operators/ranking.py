"""Multipliers, order, pages and pins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import python_tokens, stem


def multiplied(scores: DataFrame, docs: DataFrame, multiplier: Column | None) -> DataFrame:
    if multiplier is None:
        return scores
    m = docs.select("ord", multiplier.alias("m")).where("m > 0")
    return scores.join(m, "ord", "left").select("ord", (F.col("score") * F.coalesce("m", F.lit(1.0))).alias("score"))


def top(scores: DataFrame, k: int, offset: int = 0, by: list[Column] | None = None) -> DataFrame:
    """The first ``k`` rows after ``offset``, best score first and then in document order; scores that
    agree to six decimals are ties."""
    clean = scores.where(~F.isnan("score"))
    return clean.orderBy(*(by or [F.round("score", 6).desc(), F.asc("ord")])).offset(offset).limit(k)


@dataclass
class PinRule:
    """conditions: {pattern, anchoring: is | starts_with | contains, normalization: stem?};
    one that matches the query is enough. promote: id to position."""

    id: str
    conditions: list[dict]
    promote: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, json: dict) -> PinRule:
        return cls(json["id"], json["conditions"], {p["doc_id"]: int(p["position"]) for p in json["consequence"]["promote"]})

    def matches(self, term: str) -> bool:
        def norm(text: str, how: str | None) -> str:
            words = python_tokens(text)
            return " ".join(stem(w) for w in words) if how == "stem" else text.strip().lower()

        for c in self.conditions:
            a, b = norm(term, c.get("normalization")), norm(c["pattern"], c.get("normalization"))
            anchoring = c.get("anchoring", "is")
            if (anchoring == "is" and a == b) or (anchoring in ("starts_with", "startsWith") and a.startswith(b)) or (anchoring == "contains" and b in a):
                return True
        return False


def promotions(rules: list[PinRule], term: str) -> list[tuple[str, int]]:
    """(id, position) of all rules that match, by position; a document only once."""
    out: dict[str, int] = {}
    for r in rules:
        if r.matches(term):
            for k, p in sorted(r.promote.items(), key=lambda x: (x[1], x[0])):
                out.setdefault(k, p)
    return sorted(out.items(), key=lambda x: (x[1], x[0]))


def place_pins(hits: list, pins: list[tuple[object, int]], key=lambda h: h) -> list:
    """``hits`` without the pinned ones, then each pinned one put in at min(position, length),
    in order of position. ``pins``: (hit, position)."""
    pinned = {key(h) for h, _ in pins}
    out = [h for h in hits if key(h) not in pinned]
    for h, position in sorted(pins, key=lambda x: x[1]):
        out.insert(min(position, len(out)), h)
    return out

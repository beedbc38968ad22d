"""The context notation ``[!]ids@threshold:max[+]; ...`` and the strategy codes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass


class NotationError(ValueError):
    pass


@dataclass(frozen=True)
class Component:
    sources: tuple[str, ...]
    threshold: float
    most: int
    fill: bool = False
    exclude: bool = False


def parse(notation: str) -> list[Component]:
    """Components between semicolons; an empty text has none."""
    text = notation.strip()
    return [_component(part.strip()) for part in text.split(";")] if text else []


def _component(text: str) -> Component:
    if not text:
        raise NotationError("empty component")
    exclude, rest = text.startswith("!"), text.removeprefix("!")
    names, sep, tail = rest.partition("@")
    if not sep:
        raise NotationError("no @ before the threshold")
    sources = tuple(s for s in (x.strip() for x in names.split(",")) if s)
    if not sources:
        raise NotationError("no sources")
    threshold, sep, most = tail.partition(":")
    if not sep:
        raise NotationError("no : before the number of documents")
    fill = most.endswith("+")
    try:
        return Component(sources, float(threshold.strip()), _count(most.removesuffix("+").strip()), fill, exclude)
    except ValueError as e:
        raise NotationError(f"not a number in {tail!r}") from e


def _count(text: str) -> int:
    n = int(text)
    if n < 0:
        raise ValueError(text)
    return n


def all_sources(components: list[Component]) -> set[str]:
    return {s for c in components for s in c.sources}


def check_sources(components: list[Component], known: set[str]) -> None:
    for i, c in enumerate(components):
        for s in c.sources:
            if s not in known:
                raise NotationError(f"component {i}: no source {s}")


def retrieve(components: list[Component], term: str, run: Callable[[dict], dict], mode: str = "vector", exclude: bool = False, before: Callable[[dict], dict | None] | None = None) -> list[dict]:
    """The hits of each component's search, one after the other, repeats kept. With
    ``exclude`` the hits of components marked ! are taken out of those of the others. before: a
    hook that gets each request and may return another; None leaves it as it is."""
    out: list[dict] = []
    gone: set[str] = set()
    for c in components:
        request = {"term": term, "mode": mode, "similarity": c.threshold, "limit": c.most, "indexes": list(c.sources)}
        hits = run((before(request) or request) if before else request)["hits"]
        if exclude and c.exclude:
            gone |= {h["id"] for h in hits}
        else:
            out += hits
    return [h for h in out if h["id"] not in gone]


def strategy(answer: str) -> str:
    """What a planner's code asks for: 000 is simple; 001, 011 and 100 are advanced."""
    try:
        codes = json.loads(answer)
        code = codes[0] if isinstance(codes, list) and codes and isinstance(codes[0], str) else ""
        return "advanced_autoquery" if code in ("001", "011", "100") else "simple_rag"
    except ValueError:
        if "000" in answer:
            return "simple_rag"
        return "advanced_autoquery" if any(c in answer for c in ("001", "011", "100")) else "simple_rag"

"""Chat formatting: incremental rendering of a template that is a black box."""

from __future__ import annotations

import os.path
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, ship, tidy, type_of

Turns = list[tuple[str, str]]
COLUMNS = "turn long, role string, start long, stop long, text_start long, text_stop long, rewrites boolean, error string"
_ARROW = [("turn", pa.int64()), ("role", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("text_start", pa.int64()), ("text_stop", pa.int64()), ("rewrites", pa.bool_()), ("error", pa.string())]


def chatml(turns: Turns) -> str:
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


def system_in_last_user(turns: Turns) -> str:
    """Puts the system's words before the last user turn, so that a new turn moves them."""
    system = "\n".join(text for role, text in turns if role == "system")
    rest = [t for t in turns if t[0] != "system"]
    last = max((i for i, t in enumerate(rest) if t[0] == "user"), default=-1)
    out = []
    for i, (role, text) in enumerate(rest):
        if role == "user":
            text = f"{system}\n\n{text}" if system and i == last else text
            out.append(f"[INST] {text} [/INST]")
        else:
            out.append(f" {text}</s>")
    return "".join(out)


TEMPLATES: dict[str, Callable[[Turns], str]] = {"chatml": chatml, "system_in_last_user": system_in_last_user}


class Span(NamedTuple):
    start: int | None
    stop: int | None
    text_start: int | None
    text_stop: int | None
    rewrites: bool | None
    error: str | None = None


def mark_for(turns: Turns) -> str:
    """A text that no turn contains."""
    n = 1
    while True:
        mark = "\ue000" + "\ue001" * n + "\ue002"
        if not any(mark in text or mark in role for role, text in turns):
            return mark
        n += 1


def attempt(render: Callable[[Turns], str], turns: Turns) -> tuple[str | None, str | None]:
    """(rendering, None), or (None, why the template refuses the turns)."""
    try:
        return render(turns), None
    except Exception as e:  # noqa: BLE001 - a template is a black box and may raise anything
        return None, f"{type(e).__name__}: {e}"[:200]


def place(turns: Turns, now: str, render: Callable[[Turns], str], mark: str) -> tuple[int, int] | tuple[None, None]:
    """Where the last turn's text is in its rendering: where another text stands if it is put in
    its place, provided that nothing else changes with it."""
    role, text = turns[-1]
    other, _ = attempt(render, [*turns[:-1], (role, mark)]) if text else (None, None)
    at = -1 if other is None else other.rfind(mark)
    if at < 0 or other.replace(mark, text) != now:
        return None, None
    at += (len(text) - len(mark)) * other.count(mark, 0, at)
    return at, at + len(text)


def spans(turns: Turns, render: Callable[[Turns], str]) -> list[Span]:
    """The span of each turn, in characters of the rendering that the turn completes.

    The rendering of the first k turns is compared with that of the first k - 1. Where it
    goes on from it, turn k is what was added. Where it doesn't, the template rewrote its
    history: the turn is all between the longest common beginning and end of the two, and
    ``rewrites`` is true. The text's own place is found by rendering the turn with another
    text (:func:`place`), the last one if the template repeats it; it is null where the text
    is empty or the template changed it or left it out. Turns that the template refuses have
    an ``error`` and no span; the next turn is compared with the last rendering there was. A
    template that refuses the empty list begins with nothing.
    """
    out, mark = [], mark_for(turns)
    before = attempt(render, [])[0] or ""
    for k in range(1, len(turns) + 1):
        now, error = attempt(render, turns[:k])
        if now is None:
            out.append(Span(None, None, None, None, None, error))
            continue
        rewrites = not now.startswith(before)
        start, stop = len(before), len(now)
        if rewrites:
            start = len(os.path.commonprefix([before, now]))
            most = min(len(before), len(now)) - start
            end = len(os.path.commonprefix([before[len(before) - most :][::-1], now[len(now) - most :][::-1]])) if most else 0
            stop = len(now) - end
        out.append(Span(start, stop, *place(turns[:k], now, render, mark), rewrites))
        before = now
    return out


def _render(templates: dict[str, Callable[[Turns], str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, at, rows = [], [], []
            for i, turns in enumerate(batch.column(1).to_pylist()):
                plain = [(t["role"], t["text"]) for t in turns]
                for name, render in templates.items():
                    names += [name] * len(turns)
                    at += [i] * len(turns)
                    rows += [(t["turn"], t["role"], *s) for t, s in zip(turns, spans(plain, render))]
            columns = list(zip(*rows)) or [()] * len(_ARROW)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), ids, *(pa.array(c, t) for c, (_, t) in zip(columns, _ARROW))], names=["template", "conv_id", *(n for n, _ in _ARROW)])

    return run


def format_chats(conversations: DataFrame, templates: dict[str, Callable[[Turns], str]] | None = None) -> DataFrame:
    """Each turn's span under each template: ``template, conv_id, turn, role, start, stop,
    text_start, text_stop, rewrites, error`` (see :func:`spans`). conv_id is of any type.

    Turns stand in the order of (turn, role, text), nulls first; turns of one number and
    repeated rows are each a turn. Null roles and texts count as empty strings; turns
    without a conversation (null conv_id) form one conversation. An empty table gives no rows.
    A conversation is rendered by one task, each prefix anew: the work is that of a black box.
    """
    ship(conversations.sparkSession)
    turn = F.struct(col("turn").cast("long").alias("turn"), F.coalesce(col("role"), F.lit("")).alias("role"), F.coalesce(col("text"), F.lit("")).alias("text"))
    whole = conversations.select(col("conv_id").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.mapInArrow(tidy(_render(TEMPLATES if templates is None else templates)), f"template string, conv_id {type_of(conversations, 'conv_id')}, {COLUMNS}")


ORACLE = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
  from conversations),
m as (select *, 12 + length(role) + 1 + length(text) + 11 as size from t),
c as (select *, coalesce(sum(size) over (partition by conv_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as start from m),
chatml as (
  select 'chatml' as template, conv_id, turn, role, start, start + size as stop,
         case when text <> '' then start + 12 + length(role) + 1 end as text_start,
         case when text <> '' then start + 12 + length(role) + 1 + length(text) end as text_stop, false as rewrites, cast(null as varchar) as error
  from c)
select * from chatml
"""

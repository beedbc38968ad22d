"""JSON documents: paths, flattening, patches."""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship


def get_path(value, path: str):
    """The value at a dotted path; null where the path leaves the objects."""
    for k in path.split("."):
        if not isinstance(value, dict):
            return None
        value = value.get(k)
    return value


def leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """(dotted path, value) of everything but nested objects; an object of just lat and lon is a value."""
    for k, v in value.items():
        if isinstance(v, dict) and set(v) != {"lat", "lon"}:
            yield from leaves(v, f"{prefix}{k}.")
        elif v is not None:
            yield f"{prefix}{k}", v


def merge(old: dict, patch: dict) -> dict:
    """``old`` with the patch: a dotted key goes into nested objects, null removes, and a path
    through what is no object changes nothing."""
    out = copy.deepcopy(old)
    for key, value in patch.items():
        *path, last = key.split(".")
        at = out
        for k in path:
            at = at.get(k) if isinstance(at, dict) else None
        if isinstance(at, dict):
            if value is None:
                at.pop(last, None)
            else:
                at[last] = value
    return out


def merge_json(body: Column, patches: Column) -> Column:
    """``body`` with an array of patches applied in order, all JSON texts."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)

    @F.pandas_udf("string")
    def run(bodies: pd.Series, many: pd.Series) -> pd.Series:
        out = []
        for b, ps in zip(bodies, many):
            doc = json.loads(b)
            for p in [] if ps is None else ps:
                doc = merge(doc, json.loads(p))
            out.append(json.dumps(doc, ensure_ascii=False, separators=(",", ":")))
        return pd.Series(out)

    return run(body, patches)


def json_path(path: str) -> str:
    return "$" + "".join("['" + k.replace("'", "\\'") + "']" for k in path.split("."))


def public_id(index: Column, id: Column) -> Column:
    return F.concat_ws(":", index, id)


def without_prefix(id: Column, index: str) -> Column:
    """An id that may be given as ``index:id``."""
    return F.when(id.startswith(index + ":"), F.substring(id, F.lit(len(index) + 2), F.length(id))).otherwise(id)

"""Tokens, light stems and formatting of text."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{N}]+"
_PY_SPLIT = re.compile(r"[^\w]+|_+")
#: Suffixes that the English stemmer replaces first.
_SUFFIXES = (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"))
#: What light stemmers of other languages take off: the first suffix that a word has, if three
#: letters stay. Endings of number, gender and case; words of other languages are their own stems.
LIGHT = {
    "german": (("ern", ""), ("em", ""), ("en", ""), ("er", ""), ("es", ""), ("e", ""), ("n", ""), ("s", "")),
    "french": (("aux", "al"), ("ées", "é"), ("ée", "é"), ("és", "é"), ("es", ""), ("s", ""), ("x", ""), ("e", "")),
    "spanish": (("ces", "z"), ("es", ""), ("os", ""), ("as", ""), ("o", ""), ("a", ""), ("e", ""), ("s", "")),
    "italian": (("chi", "c"), ("ghi", "g"), ("che", "c"), ("ghe", "g"), ("i", ""), ("e", ""), ("o", ""), ("a", "")),
    "portuguese": (("ões", "ão"), ("ães", "ão"), ("ais", "al"), ("es", ""), ("os", ""), ("as", ""), ("o", ""), ("a", ""), ("s", "")),
    "dutch": (("heden", "heid"), ("en", ""), ("s", ""), ("e", "")),
    "swedish": (("orna", ""), ("arna", ""), ("erna", ""), ("ar", ""), ("er", ""), ("or", ""), ("en", ""), ("et", ""), ("a", ""), ("e", "")),
}
ENGLISH = "english"
#: Letters of a stem that a light stemmer leaves at least.
LEAST_STEM = 3
_ENDINGS = [*_SUFFIXES, *(x for endings in LIGHT.values() for x in endings), ("s", ""), ("ed", ""), ("ing", "")]
#: Letters at the end of a stem that its word needn't begin with: what comes before them does.
STEM_TAIL = max(len(new) - len(os.path.commonprefix([end, new])) for end, new in _ENDINGS)
#: Letters by which a word is longer than its stem at most; it is never shorter. One is for a doubled letter.
STEM_CUT = max(len(end) - len(new) for end, new in _ENDINGS) + 1


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; hyphens separate."""
    return F.array_remove(F.split(F.lower(text), SPLIT), "")


def begins(words: Column) -> Column:
    """Where in a sorted array, which isn't null, each different word begins."""
    places = F.sequence(F.lit(0), F.size(words) - 1)
    return F.when(F.size(words) > 0, F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))).otherwise(F.array().cast("array<int>"))


def has_tokens(text: Column) -> Column:
    """Whether there are :func:`tokens`, without making them."""
    return F.lower(text).rlike(r"[\p{L}\p{N}]")


def python_tokens(text: str) -> list[str]:
    return [t for t in _PY_SPLIT.split(text.lower()) if t]


def stem(token: str, language: str = ENGLISH) -> str:
    """A light stem: in English plural, past and continuous forms fall together, in others LIGHT."""
    if language != ENGLISH:
        for end, new in LIGHT.get(language, ()):
            if token.endswith(end) and len(token) - len(end) >= LEAST_STEM:
                return token[: len(token) - len(end)] + new
        return token
    for end, new in _SUFFIXES:
        if token.endswith(end) and len(token) > len(end) + 1:
            return token[: -len(end)] + new
    for end in ("ing", "ed"):
        base = token[: -len(end)]
        if token.endswith(end) and len(base) >= 3 and re.search("[aeiouy]", base):
            return base[:-1] if len(base) > 3 and base[-1] == base[-2] and base[-1] not in "lsz" else base
    if token.endswith("s") and not token.endswith(("ss", "us", "is")) and len(token) > 3:
        return token[:-1]
    return token


def stem_expr(token: Column, language: str = ENGLISH) -> Column:
    """:func:`stem` as an expression; the two agree on every token."""
    n = F.length(token)
    if language != ENGLISH:
        out = token
        for end, new in reversed(LIGHT.get(language, ())):
            out = F.when(token.endswith(end) & (n - len(end) >= LEAST_STEM), F.concat(F.substring(token, F.lit(1), n - len(end)), F.lit(new))).otherwise(out)
        return out
    out = F.when(token.endswith("s") & ~token.endswith("ss") & ~token.endswith("us") & ~token.endswith("is") & (n > 3), F.substring(token, F.lit(1), n - 1)).otherwise(token)
    for end in ("ed", "ing"):
        k = len(end)
        base = F.substring(token, F.lit(1), n - k)
        last, before = F.substring(token, n - k, F.lit(1)), F.substring(token, n - k - 1, F.lit(1))
        double = (n - k > 3) & (last == before) & ~last.isin("l", "s", "z")
        cut = F.when(double, F.substring(token, F.lit(1), n - k - 1)).otherwise(base)
        out = F.when(token.endswith(end) & (n - k >= 3) & base.rlike("[aeiouy]"), cut).otherwise(out)
    for end, new in reversed(_SUFFIXES):
        out = F.when(token.endswith(end) & (n > len(end) + 1), F.concat(F.substring(token, F.lit(1), n - len(end)), F.lit(new))).otherwise(out)
    return out


def length_gate(value: Column, low: int = 1, high: int = 25) -> Column:
    """The value if it has from ``low`` to ``high`` bytes, else null."""
    return F.when(F.octet_length(value).between(low, high), value)


def explicit_enum(value: Column) -> Column:
    """x of ``enum('x')`` or ``enum(`x`)``, else null."""
    found = F.coalesce(F.nullif(F.regexp_extract(value, r"^enum\('([^']*)'\)$", 1), F.lit("")), F.nullif(F.regexp_extract(value, r"^enum\(`([^`]*)`\)$", 1), F.lit("")))
    return found


def chunks(text: Column, size: int, overlap: float = 0.02) -> Column:
    """Windows of ``size`` tokens, each sharing ``overlap`` of them with the one before."""
    step = max(1, size - round(size * overlap))

    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(words) - size) / step), F.lit(0)).cast("int"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "))

    # Tokens are an array's only item so that they are made once, not for each window.
    return F.flatten(F.transform(F.array(tokens(text)), windows))


def humanize(key: str) -> str:
    """``first_name``, ``first-name`` and ``firstName`` to ``First Name``; ``HTMLPage`` to ``HTML Page``."""
    text = re.sub(r"[_-]", " ", key)
    text = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", text)
    return re.sub(r"(^| )([^ ])", lambda m: m[1] + m[2].upper(), text)


def format_properties(values: dict, properties: list[str], with_keys: set[str] | frozenset[str] = frozenset()) -> str:
    """Chosen properties of a document as text, joined by ``. ``; keys of ``with_keys`` are named."""
    parts = []
    for p in properties:
        v: object = values
        for k in p.split("."):
            v = v.get(k) if isinstance(v, dict) else None
        if isinstance(v, list):
            items = [str(x) for x in v if isinstance(x, (str, int, float)) and not isinstance(x, bool)]
            text = ", ".join(items) if items else None
        else:
            text = ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, (str, int, float)) else None
        if text is not None:
            parts.append(f"{humanize(p)} {text}" if p in with_keys else text)
    return ". ".join(parts)


def fill_template(template: str, variables: dict[str, str]) -> str:
    for k, v in variables.items():
        template = template.replace("{{" + k + "}}", v)
    return template

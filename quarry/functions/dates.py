"""Dates as milliseconds in UTC."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX][X]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy")
#: The form of mail headers, after the day of the week.
MAIL = "d MMM yyyy HH:mm:ss Z"
_LOOKS = re.compile(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$|^\d{4}/\d{2}/\d{2}$|^\d{2}/\d{2}/\d{4}$|^\w{3}, \d{1,2} \w{3} \d{4} ")


def parse(text: str) -> int | None:
    """Milliseconds since 1970 of a date in one of several forms; UTC unless it says otherwise."""
    if not _LOOKS.match(text):
        return None
    for attempt in (lambda: datetime.fromisoformat(text.replace("Z", "+00:00")), lambda: datetime.strptime(text, "%Y/%m/%d"), lambda: datetime.strptime(text, "%m/%d/%Y"), lambda: parsedate_to_datetime(text)):
        try:
            d = attempt()
        except (ValueError, TypeError):
            continue
        d = d if d.tzinfo else d.replace(tzinfo=UTC)
        return (int(d.timestamp()) * 1000) + d.microsecond // 1000
    return None


def millis(value: Column) -> Column:
    return F.unix_millis(value.cast("timestamp"))


def lenient(text: Column) -> Column:
    """The timestamp that a text says in one of FORMATS or as in mail, else null."""
    mail = F.try_to_timestamp(F.regexp_extract(text, "^[A-Za-z]{3}, (.*)$", 1), F.lit(MAIL))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS], mail)

"""Tier keys, primary keys and lake transforms as Spark columns and as Python values.

A tier key is one 64-bit number that orders rows by age: bigints are themselves, timestamps (with or without zone, the
latter read as UTC) are microseconds since the epoch, dates are days. A primary key is one text.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "\x1f"
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
_MICRO = dt.timedelta(microseconds=1)


class KeyError_(ValueError):
    """A tier key, primary key or duration that can't be read."""


class TierKind(Enum):
    BIGINT = "bigint"
    TIMESTAMP = "timestamp"
    TIMESTAMPTZ = "timestamptz"
    DATE = "date"

    @classmethod
    def of(cls, kind: T.DataType) -> TierKind:
        if isinstance(kind, T.IntegralType):
            return cls.BIGINT
        if isinstance(kind, T.TimestampNTZType):
            return cls.TIMESTAMP
        if isinstance(kind, T.TimestampType):
            return cls.TIMESTAMPTZ
        if isinstance(kind, T.DateType):
            return cls.DATE
        raise KeyError_(f"{kind.simpleString()} can't be a tier key")

    def to_long(self, column: Column) -> Column:
        if self is TierKind.BIGINT:
            return column.cast("long")
        if self is TierKind.DATE:
            return F.unix_date(column).cast("long")
        # A zoneless timestamp is read in the session zone, which the engine keeps at UTC.
        return F.unix_micros(column.cast("timestamp"))

    def literal(self, key: int) -> Column:
        """The key as a literal of the column's own type, so that comparisons reach the scan."""
        if self is TierKind.BIGINT:
            return F.lit(key).cast("long")
        # Keys beyond the calendar, such as the line below all keys, become its first or last day.
        first, last = self.parse("0001-01-01"), self.parse("9999-12-31")
        key = min(max(key, first), last)
        if self is TierKind.DATE:
            return F.lit(dt.date(1970, 1, 1) + dt.timedelta(days=key))
        moment = _EPOCH + key * _MICRO
        text = moment.replace(tzinfo=None).isoformat(sep=" ", timespec="microseconds")
        return F.lit(text).cast("timestamp_ntz") if self is TierKind.TIMESTAMP else F.lit(text + "+00:00").cast("timestamp")

    def parse(self, value: object) -> int:
        """A Python value or text as a key."""
        if self is TierKind.BIGINT:
            try:
                return int(value)
            except (TypeError, ValueError):
                raise KeyError_(f"not a bigint key: {value!r}") from None
        if isinstance(value, dt.datetime):
            moment = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        elif isinstance(value, dt.date):
            moment = dt.datetime(value.year, value.month, value.day, tzinfo=dt.timezone.utc)
        elif isinstance(value, str):
            moment = _moment(value)
        else:
            raise KeyError_(f"not a {self.value} key: {value!r}")
        micros = (moment - _EPOCH) // _MICRO
        return micros // 86_400_000_000 if self is TierKind.DATE else micros

    def duration(self, text: str | int) -> int:
        """7d, 12h, 30m, 10s, or a bare number of the key's own units. Dates take whole days only."""
        m = re.fullmatch(r"(\d+)([dhms]?)", str(text).strip())
        if not m:
            raise KeyError_(f"not a duration: {text!r}")
        n, unit = int(m[1]), m[2]
        if not unit:
            return n
        seconds = n * {"d": 86400, "h": 3600, "m": 60, "s": 1}[unit]
        if self is TierKind.BIGINT:
            raise KeyError_("a bigint key has durations in its own units")
        if self is TierKind.DATE:
            if seconds % 86400:
                raise KeyError_("a date key has durations of whole days")
            return seconds // 86400
        return seconds * 1_000_000

    def token(self, key: int) -> str:
        """A short name of the key for partition names."""
        if self is TierKind.BIGINT:
            return f"m{-key}" if key < 0 else str(key)
        if self is TierKind.DATE:
            return (dt.date(1970, 1, 1) + dt.timedelta(days=key)).strftime("%Y%m%d")
        moment = _EPOCH + key * _MICRO
        return moment.strftime("%Y%m%d" if not key % 86_400_000_000 else "%Y%m%d%H%M%S")


def _moment(text: str) -> dt.datetime:
    m = re.fullmatch(r"\s*(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d(?::\d\d)?)(\.\d+)?)?\s*(Z|z|[+-]\d\d(?::?\d\d)?(?::?\d\d)?)?\s*", text)
    if not m:
        raise KeyError_(f"not a point in time: {text!r}")
    day, clock, fraction, zone = m.groups()
    clock = clock or "00:00:00"
    try:
        moment = dt.datetime.fromisoformat(f"{day}T{clock if clock.count(':') == 2 else clock + ':00'}")
    except ValueError as e:
        raise KeyError_(f"not a point in time: {text!r}") from e
    moment = moment.replace(microsecond=int((fraction or ".0")[1:7].ljust(6, "0")), tzinfo=dt.timezone.utc)
    if zone and zone not in "Zz":
        digits = zone[1:].replace(":", "").ljust(6, "0")
        offset = dt.timedelta(hours=int(digits[:2]), minutes=int(digits[2:4]), seconds=int(digits[4:]))
        moment += offset if zone[0] == "-" else -offset
    return moment


def floor_to(x: Column | int, width: int) -> Column | int:
    """The largest multiple of width that isn't above x, negative numbers too."""
    if isinstance(x, int):
        return x // width * width
    return x - F.pmod(x, F.lit(width).cast("long"))


#: Types whose text form is the same everywhere; others can't be primary keys.
_KEY_TYPES = (T.IntegralType, T.StringType, T.DateType, T.BooleanType)


def pk_text(columns: Sequence[str], schema: T.StructType) -> Column:
    """The primary key as one text: a single column's text, or the escaped texts joined by U+001F. Null if any is null."""
    for c in columns:
        if not isinstance(schema[c].dataType, _KEY_TYPES):
            raise KeyError_(f"{c}: {schema[c].dataType.simpleString()} can't be in a primary key")
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    if len(texts) == 1:
        return texts[0]
    escaped = [F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit(SEPARATOR), F.lit("\\" + SEPARATOR)) for t in texts]
    return F.concat(*[x for i, e in enumerate(escaped) for x in ([F.lit(SEPARATOR), e] if i else [e])])


def encode_pk(values: Sequence[object]) -> str:
    """What pk_text makes of one row's key."""
    if any(v is None for v in values):
        raise KeyError_("a primary key can't be null")
    texts = [("true" if v else "false") if isinstance(v, bool) else str(v) for v in values]
    if len(texts) == 1:
        return texts[0]
    return SEPARATOR.join(t.replace("\\", "\\\\").replace(SEPARATOR, "\\" + SEPARATOR) for t in texts)


def decode_pk(text: str, n: int) -> list[str]:
    """The texts that encode_pk joined."""
    if n == 1:
        return [text]
    out, at = [""], 0
    while at < len(text):
        if text[at] == "\\" and at + 1 < len(text):
            out[-1] += text[at + 1]
            at += 2
            continue
        if text[at] == SEPARATOR:
            out.append("")
        else:
            out[-1] += text[at]
        at += 1
    if len(out) != n:
        raise KeyError_(f"not a key of {n} columns: {text!r}")
    return out


class Layout:
    """How the lake is partitioned: none, truncate(width), or by hour, day, month or year of the tier key."""

    def __init__(self, spec: str | int | None):
        self.width = int(spec) if isinstance(spec, int) or (spec and str(spec).isdigit()) else 0
        self.unit = spec if spec in ("hour", "day", "month", "year") else None
        if spec and not self.width and not self.unit:
            raise ValueError(f"not a layout: {spec!r}")

    def bucket(self, key: Column, kind: TierKind) -> Column:
        """The bucket a tier key (as a long) falls in, named by its least key."""
        if self.width:
            return floor_to(key, self.width)
        if not self.unit:
            return F.lit(0).cast("long")
        if kind is TierKind.BIGINT:
            raise ValueError("a bigint key has no calendar")
        if self.unit in ("hour", "day"):
            return key if kind is TierKind.DATE else floor_to(key, 3_600_000_000 if self.unit == "hour" else 86_400_000_000)
        if kind is TierKind.DATE:
            return F.unix_date(F.trunc(F.date_from_unix_date(key.cast("int")), self.unit)).cast("long")
        return F.unix_micros(F.date_trunc(self.unit, F.timestamp_micros(key)))

    def one_bucket(self, low: int, high: int) -> bool:
        """Whether a file with these keys lies in one bucket of truncate(width). Calendar layouts don't adopt files."""
        if self.unit:
            raise ValueError("files can't be adopted into a calendar layout")
        return not self.width or low // self.width == high // self.width

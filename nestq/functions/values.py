"""Literals, dates and cursors."""

from __future__ import annotations

import base64
import datetime as dt
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.errors import QueryError

DATE_PATTERNS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd")


def parse_datetime(value: Any) -> dt.datetime:
    """Seconds or milliseconds since the epoch, RFC 3339, ``yyyy-MM-dd HH:mm:ss`` or ``yyyy-MM-dd``; UTC unless it says otherwise."""
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    try:
        if isinstance(value, bool):
            raise ValueError
        if isinstance(value, (int, float)) or (isinstance(value, str) and value.strip().lstrip("-").isdigit()):
            n = float(value)
            return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=n / 1000 if abs(n) >= 1e11 else n)
        found = dt.datetime.fromisoformat(str(value).strip().replace("Z", "+00:00"))
    except ValueError:
        raise QueryError(f"{value!r} is not a date or time") from None
    return found.astimezone(dt.timezone.utc).replace(tzinfo=None) if found.tzinfo else found


def flexible_timestamp(c: Column) -> Column:
    """The same forms as ``parse_datetime`` in a string column; null when none fits."""
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(r"^-?[0-9]+$"), text.try_cast("bigint"))
    epoch = F.when(F.abs(number) >= 100_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    return F.coalesce(epoch, *[F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS])


def typed_literal(value: Any, kind: T.DataType, where: str = "") -> Column:
    """A literal of the column's type; a value that does not fit is an error before anything runs."""
    bad = QueryError(f"value {value!r} of {where} is no {kind.simpleString()}")
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.BooleanType):
        if not isinstance(value, bool):
            raise bad
        return F.lit(value)
    if isinstance(kind, T.IntegralType):
        try:
            if isinstance(value, bool) or (isinstance(value, float) and not value.is_integer()):
                raise ValueError
            n = int(value)
        except (TypeError, ValueError):
            if isinstance(value, float):
                return F.lit(value)  # 1.5 compares with whole numbers
            raise bad from None
        size = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[kind.simpleString()]
        if -(1 << size - 1) <= n < 1 << size - 1:
            return F.lit(n).cast(kind)
        if not -(1 << 63) <= n < 1 << 63:
            raise bad
        return F.lit(n)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        try:
            if isinstance(value, bool):
                raise ValueError
            return F.lit(str(value)).cast(kind) if isinstance(kind, T.DecimalType) else F.lit(float(value)).cast(kind)
        except (TypeError, ValueError):
            raise bad from None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        when = parse_datetime(value)
        if isinstance(kind, T.DateType):
            return F.lit(when.date())
        if isinstance(kind, T.TimestampNTZType):
            return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")
        return F.lit(when.isoformat(sep=" ") + "+00:00").cast("timestamp")
    if isinstance(value, (dict, list)):
        return F.lit(json.dumps(value))
    if isinstance(value, bool):
        return F.lit("true" if value else "false")
    return F.lit(str(value))


def encode_cursor(key: dict[str, Any]) -> str:
    return base64.b64encode(json.dumps(key, separators=(",", ":"), default=str).encode()).decode()


def decode_cursor(cursor: Any, names: list[str]) -> dict[str, Any]:
    """The key in a cursor; a plain value is the key itself."""
    if isinstance(cursor, dict) and set(cursor) == set(names):
        return cursor
    if isinstance(cursor, str):
        try:
            found = json.loads(base64.b64decode(cursor, validate=True))
            if isinstance(found, dict) and set(found) == set(names):
                return found
        except ValueError:
            pass
    if len(names) != 1 or isinstance(cursor, (dict, list)) or cursor is None:
        raise QueryError(f"{cursor!r} is no cursor")
    return {names[0]: cursor}


def get_path(c: Column, path: str) -> Column:
    """A value inside JSON text by dotted path."""
    return F.get_json_object(c, "$." + path)


def erase_path(value: dict[str, Any], path: str) -> dict[str, Any]:
    """``value`` without what a dotted path leads to."""
    head, _, rest = path.partition(".")
    if not rest:
        return {k: v for k, v in value.items() if k != head}
    return {k: erase_path(v, rest) if k == head and isinstance(v, dict) else v for k, v in value.items()}

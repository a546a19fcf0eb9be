"""Values off the wire: exact coercion by column type, case folding and rendering. No Spark session is needed."""

from __future__ import annotations

import math
import re
import unicodedata
from datetime import UTC, datetime, timedelta
from decimal import ROUND_DOWN, Decimal, InvalidOperation

I64_MIN, I64_MAX, SAFE_MS = -(1 << 63), (1 << 63) - 1, 1 << 53
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)

_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)")
_RADIX = re.compile(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+")
_ISO = re.compile(r"([+-]\d{6}|\d{4})(?:-(\d{2})(?:-(\d{2}))?)?(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(Z|[+-]\d{2}:?\d{2})?)?")
_SLUG = re.compile(r"[A-Za-z0-9_-]+")
#: White space that the wire's number grammar trims.
_BLANK = " \t\n\v\f\r                 　﻿"


class BadValue(ValueError):
    """A value that its column's type doesn't take."""


def number(raw: str) -> float | int:
    """The grammar of numbers on the wire: decimal, exponent, hexadecimal, octal, binary, Infinity; blanks around are allowed."""
    text = raw.strip(_BLANK)
    if _RADIX.fullmatch(text):
        return int(text, 0)
    if text.lstrip("+-") == "Infinity" and len(text) <= 9:
        return -math.inf if text[0] == "-" else math.inf
    if not _NUMBER.fullmatch(text):
        raise BadValue(f'"{raw}" is not a valid number')
    if re.fullmatch(r"[+-]?\d{1,15}", text):
        return int(text)
    return float(text)


def integer(raw: str) -> int:
    n = number(raw)
    if isinstance(n, float):
        if not n.is_integer():
            raise BadValue(f'"{raw}" is not an integer')
        n = int(n)
    return n


def boolean(raw: str) -> bool:
    if raw not in ("true", "false"):
        raise BadValue(f'"{raw}" is not a boolean (use true/false)')
    return raw == "true"


def int64(raw: str | int) -> int:
    if isinstance(raw, bool) or not (isinstance(raw, int) or isinstance(raw, str) and re.fullmatch(r"-?\d+", raw)):
        raise BadValue(f'"{raw}" is not an integer of 64 bits')
    n = int(raw)
    if not I64_MIN <= n <= I64_MAX:
        raise BadValue(f'"{raw}" is out of the range of 64 bits')
    return n


def decimal(raw: str | int | Decimal, scale: int, precision: int | None) -> Decimal:
    """Exact at the scale: excess digits are an error, never rounded."""
    text = str(raw)
    if isinstance(raw, bool | float) or not re.fullmatch(r"-?\d+(?:\.\d+)?", text):
        raise BadValue(f'"{raw}" is not a decimal')
    try:
        value = Decimal(text)
    except InvalidOperation as e:
        raise BadValue(f'"{raw}" is not a decimal') from e
    if value != value.quantize(Decimal(1).scaleb(-scale), ROUND_DOWN):
        raise BadValue(f'"{raw}" has more than {scale} fraction digits')
    units = int(value.scaleb(scale))
    if precision is not None and abs(units) >= 10**precision or not I64_MIN <= units <= I64_MAX:
        raise BadValue(f'"{raw}" has more digits than ({precision}, {scale}) allows')
    return Decimal(units).scaleb(-scale)


def epoch_ms(raw: str | int | float | datetime) -> int:
    """An instant in milliseconds: a bare integer is one already; ISO 8601 without a zone is taken as UTC."""
    if isinstance(raw, datetime):
        return (raw.replace(tzinfo=raw.tzinfo or UTC) - EPOCH) // timedelta(milliseconds=1)
    if isinstance(raw, str) and not re.fullmatch(r"-?\d+", raw):
        found = _ISO.fullmatch(raw.strip())
        if not found:
            raise BadValue(f'"{raw}" is not a date')
        year, month, day, hour, minute, second, fraction, zone = found.groups()
        try:
            h = int(hour or 0)
            at = datetime(int(year), int(month or 1), int(day or 1), h % 24, int(minute or 0), int(second or 0), tzinfo=UTC) + timedelta(days=h // 24)
        except ValueError as e:
            raise BadValue(f'"{raw}" is not a date') from e
        if h > 24 or h == 24 and (at.minute or at.second):
            raise BadValue(f'"{raw}" is not a date')
        ms = (at - EPOCH) // timedelta(milliseconds=1) + int((fraction or "0").ljust(3, "0")[:3])
        if zone and zone != "Z":
            digits = zone[1:].replace(":", "")
            ms -= (1 if zone[0] == "+" else -1) * (int(digits[:2]) * 60 + int(digits[2:])) * 60_000
        return ms
    ms = int(raw)
    if isinstance(raw, bool) or isinstance(raw, float) and not math.isfinite(raw) or abs(ms) > SAFE_MS:
        raise BadValue(f'"{raw}" is not a date')
    return ms


def instant(ms: int) -> datetime:
    """Without a zone, as it is compared with Spark's timestamps in UTC; clamped to the years Python has."""
    low, high = datetime(1, 1, 1), datetime(9999, 12, 31, 23, 59, 59, 999000)
    try:
        return datetime(1970, 1, 1) + timedelta(milliseconds=ms)
    except OverflowError:
        return low if ms < 0 else high


def now_shifted(expression: str, now: datetime) -> datetime:
    """$now, or $now(+3 day): units from second to year, in UTC; a month too short gives its overflow to the next."""
    found = re.fullmatch(r"\$now(?:\(\s*([+-]?\d+)\s*(second|minute|hour|day|week|month|year)s?\s*\))?", expression.strip())
    if not found:
        raise BadValue(f'"{expression}" is no relative date')
    n, unit = int(found[1] or 0), found[2] or "second"
    if unit in ("month", "year"):
        months = now.year * 12 + now.month - 1 + n * (12 if unit == "year" else 1)
        first = now.replace(year=months // 12, month=months % 12 + 1, day=1)
        return first + timedelta(days=now.day - 1)
    return now + timedelta(**{f"{unit}s": n})


def locale_slug(raw: str) -> str:
    if not raw or len(raw.encode()) > 35 or not _SLUG.fullmatch(raw):
        raise BadValue(f'"{raw}" is no locale: up to 35 of letters, digits, _ and -')
    return raw


def fold(text: str) -> str:
    """Compatibility composition, then lower case: not full case folding, so a sharp s stays."""
    return unicodedata.normalize("NFKC", text).lower()


def render_double(value: float) -> str:
    """The shortest form that reads back the same: 1 for 1.0, 1e+21 from there on, 1e-7 below a millionth."""
    if not math.isfinite(value):
        return "null"
    if value == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    text = "".join(map(str, digits))
    point = len(text) + exponent
    if 0 < point <= 21:
        body = text + "0" * (point - len(text)) if point >= len(text) else f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + text
    else:
        body = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{point - 1:+d}"
    return "-" + body if sign else body


def render_instant(value: datetime | int) -> str:
    ms = value if isinstance(value, int) else epoch_ms(value)
    days, rest = divmod(ms, 86_400_000)
    at = EPOCH + timedelta(days=days)
    return f"{at.year:04d}-{at.month:02d}-{at.day:02d}T{rest // 3_600_000:02d}:{rest // 60_000 % 60:02d}:{rest // 1000 % 60:02d}.{rest % 1000:03d}Z"


def render_decimal(value: Decimal, scale: int) -> str:
    """At the fixed scale; zero has no sign."""
    text = f"{value:.{scale}f}"
    return text.lstrip("-") if not Decimal(text) else text


def media_category(mime: str) -> str:
    """The kind of asset that a MIME type names."""
    top = mime.split("/", 1)[0].lower()
    return {"image": "images", "video": "videos", "audio": "audios"}.get(top, "files")

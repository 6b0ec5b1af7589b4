"""Parsing of parameters and formatting of numbers, on the driver or within a UDF."""

from __future__ import annotations

import math
import re
from datetime import UTC, datetime
from decimal import Decimal

#: Shortest decimal text takes an exponent below the first and from the second on.
LEAST_EXPONENT, MOST_EXPONENT = -4, 6

_RFC3339 = re.compile(r"(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:\d{2})", re.ASCII)


def shortest(value: float, most: int = MOST_EXPONENT) -> str:
    """The shortest text that reads back as the same number: ``1``, ``1.5``, ``1e+06``, ``+Inf``, ``NaN``.

    The exponent has two digits at least. An exponent is taken when the decimal exponent is under -4, or ``most`` or more.
    """
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "+Inf" if value > 0 else "-Inf"
    sign = "-" if math.copysign(1.0, value) < 0 else ""
    if value == 0:
        return sign + "0"
    digits = "".join(map(str, Decimal(repr(abs(value))).as_tuple().digits))
    exponent = Decimal(repr(abs(value))).adjusted()
    digits = digits.rstrip("0") or "0"
    if exponent < LEAST_EXPONENT or exponent >= most:
        mantissa = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
        return f"{sign}{mantissa}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{digits}"
    whole, rest = digits[: exponent + 1].ljust(exponent + 1, "0"), digits[exponent + 1 :]
    return sign + whole + ("." + rest if rest else "")


def time_param(text: str) -> int:
    """Milliseconds of an RFC 3339 time or of seconds since 1970 (a float; the rest below a millisecond is cut off)."""
    if not text:
        raise ValueError("time is missing")
    if m := _RFC3339.fullmatch(text):
        at = datetime.fromisoformat(text[:19] + (m[8] if m[8] != "Z" else "+00:00")).astimezone(UTC)
        whole = at - datetime(1970, 1, 1, tzinfo=UTC)
        return (whole.days * 86_400 + whole.seconds) * 1000 + int((m[7] or "0").ljust(3, "0")[:3])
    if text != text.strip() or "_" in text:
        raise ValueError(f"no time: {text!r}")
    number = float(text)
    if not math.isfinite(number):
        raise ValueError(f"no time: {text!r}")
    return int(number * 1000)


def retention_days(text: str) -> int:
    """``""`` and ``0`` keep everything (0); ``30d`` keeps thirty days."""
    text = text.strip()
    if text in ("", "0"):
        return 0
    if not re.fullmatch(r"\+?\d+d", text, re.ASCII):
        raise ValueError(f"retention period must be a number of days such as 30d: {text!r}")
    return int(text[:-1])

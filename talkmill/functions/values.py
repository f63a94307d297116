"""Comparing free-text values: strictly, or by the numbers they hold."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: magnitude words and what they multiply by; markers of approximation; signs dropped at either end
MAGNITUDES = {"thousand": 1_000, "k": 1_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "l": 100_000, "crore": 10_000_000, "crores": 10_000_000, "cr": 10_000_000}
APPROXIMATE = ("~", "around", "approx", "approximately", "about", "roughly", "circa", "ca", "ish")
OUTER = " \t\r\n.,;:!?-–—"
_TOKEN = re.compile(r"\d+(?:\.\d+)?|[^\W\d_]+|~")


def strict(value: str) -> str:
    """Compatibility form, case folded, white space collapsed, without outer punctuation."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value).casefold()).strip(OUTER)


def numbers(value: str) -> tuple[list[float], bool, list[str]] | None:
    """Numbers with their magnitudes applied, whether approximate, and the words left over; None without a number.

    A magnitude belongs to the number before it; if only one is written, for several numbers, it is shared by all.
    """
    text = re.sub(r"(?<=\d),(?=\d)", "", re.sub("[‐-―−]", "-", strict(value)))
    found, factors, words, approx = [], [], [], False
    for t in _TOKEN.findall(text):
        if t[0].isdigit():
            found.append(float(t))
            factors.append(None)
        elif t in MAGNITUDES and found and factors[-1] is None:
            factors[-1] = MAGNITUDES[t]
        elif t in APPROXIMATE:
            approx = True
        else:
            words.append(t)
    if not found:
        return None
    given = [f for f in factors if f is not None]
    if len(given) == 1:
        factors = given * len(found)
    return [n * (f or 1) for n, f in zip(found, factors)], approx, sorted(words)


def value_key(value: str) -> str:
    """Equal for values that mean the same: by numbers where there are any, else strictly."""
    got = numbers(value)
    if got is None:
        return strict(value)
    return f"num:{','.join(f'{n:.6g}' for n in got[0])}|approx:{int(got[1])}|words:{' '.join(got[2])}"


def agree(a: str, b: str, how: str = "strict") -> bool:
    if how not in ("strict", "number_aware"):
        raise ValueError(f"no such comparison: {how}")
    return strict(a) == strict(b) if how == "strict" else value_key(a) == value_key(b)


def _column(f):
    def run(value: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in value.to_pylist()], pa.string())

    run.__annotations__ = {"value": pa.Array, "return": pa.Array}
    return run


def strict_key(c: Column) -> Column:
    return F.arrow_udf(_column(strict), "string")(c)


def number_key(c: Column) -> Column:
    return F.arrow_udf(_column(value_key), "string")(c)

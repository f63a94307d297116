"""Reading written times: every valid interpretation of a value, as arrays, by numpy over batches.

A batch is grouped by the *shape* of its values (digits as 9, letters as they are). A shape is parsed once, which
gives the places of its fields; the fields of all values of that shape are then read as columns of a byte matrix.

An interpretation is an instant (microseconds since 1970 UTC) and the form it was read in. A value has
  none   if it is null, blank, no time, only a day or an hour, outside the calendar, or in a skipped local hour;
  one    if everything is written or known of its file;
  more   if the order of day and month isn't known, or its zone has the local time twice.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MON = "|".join(sorted({*FULL_MONTHS, *MONTHS, "sept"}, key=len, reverse=True))
_DAY = "(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)(?:day|sday|nesday|rsday|urday)?"
_ZONE = r"[a-z]+(?:[_-][a-z]+)*(?:/[a-z]+(?:[_-][a-z]+)*)+"
SHAPE = re.compile(
    rf"""\[?(?:{_DAY}\.?,?\ +)?
    (?:(?P<y1>9999)(?P<s1>[-./])(?P<m1>99?)(?P=s1)(?P<d1>99?)
      |(?P<a>99?)(?P<s2>[-./])(?P<b>99?)(?P=s2)(?P<y2>9999|99)
      |(?P<d3>99?)(?:st|nd|rd|th)?[\ \-.]*(?P<n3>{_MON})[\ \-.,]*(?P<y3>9999|99)
      |(?P<n4>{_MON})[\ .]*(?P<d4>99?)(?:st|nd|rd|th)?,?\ +(?P<y4>9999)
      |(?P<c>99999999))
    (?:,?\ +|t|\ ?,\ ?)(?:at\ )?
    (?:(?P<h>99?)(?::(?P<i>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?)?(?:\ ?(?P<ap>[ap])\.?m\.?)?
      |(?P<hc>99)(?P<ic>99)(?P<sc>99)?(?:[.,](?P<fc>9+))?)
    \]?
    (?:\ ?(?P<z>z)|\ ?(?:gmt|utc)?(?P<o>[+-])(?P<oh>99?)(?::?(?P<om>99))?|\ ?(?P<w>[a-z]{{2,5}}))?
    (?:\ ?\[(?P<iz>{_ZONE})\]|\ (?P<iz2>{_ZONE}))?\]?""",
    re.X,
)
EPOCH = re.compile(r"(9{10})(?:\.(9+))?|(9{13})|(9{16})|(9{19})")
_TO_SHAPE = str.maketrans("012345678", "999999999")
_PLAIN = {ord("−"): "-", ord("–"): "-", 0xA0: " ", 0x202F: " ", 0xFEFF: None}
_PLAIN |= {base + d: str(d) for base in (0x660, 0x6F0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xFF10) for d in range(10)}
_FIRST, _LAST = -62135596800, 253402300799  # years 1 to 9999


@lru_cache(maxsize=512)
def zone_table(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The instants at which a zone's offset changes (seconds), and the offsets from before the first on; None if unknown."""
    try:
        zone = ZoneInfo(name.strip())
    except (ValueError, OSError, KeyError):
        return None
    off = lambda t: int(datetime.fromtimestamp(t, timezone.utc).astimezone(zone).utcoffset().total_seconds())
    step, first, last = 86400 * 3, -2208988800, 4102444800
    at, offsets, t = [], [off(first)], first
    while t < last:
        if off(t + step) != offsets[-1]:
            lo, hi = t, t + step
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if off(mid) == offsets[-1] else (lo, mid)
            at.append(hi)
            offsets.append(off(hi))
            t = hi
        else:
            t += step
    return np.array(at, np.int64), np.array(offsets, np.int64)


def to_utc(local: np.ndarray, zone: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Up to two readings (instants, which of them exist) of local seconds in a zone; unknown zones have none."""
    found = zone_table(zone) if zone else None
    if found is None:
        return []
    at, offsets = found
    k = np.searchsorted(at, local - 93600, side="right")
    out, taken = [], np.zeros((len(local), 0), np.int64)
    for step in range(3):
        j = np.minimum(k + step, len(at))
        utc = local - offsets[j]
        inside = (np.searchsorted(at, utc, side="right") == j) & ~(taken == utc[:, None]).any(axis=1)
        if inside.any():
            out.append((utc, inside))
            taken = np.column_stack([taken, np.where(inside, utc, np.iinfo(np.int64).min)])
    return out


def days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 of dates, and which of them are dates at all."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + ((m == 2) & leap)
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (d <= length) & (y >= 1)
    yy = y - (m <= 2)
    era = yy // 400
    yoe = yy - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468, ok


@lru_cache(maxsize=20_000)
def layout(shape: str) -> tuple[dict, str] | None:
    """Where the fields of a shape are, and the name of its form."""
    if m := EPOCH.fullmatch(shape):
        return {"epoch": m.lastindex if m.group(2) is None else 1, "m": m}, f"epoch{len(shape.split('.')[0])}"
    if not (m := SHAPE.fullmatch(shape)) or m["ap"] and (m["hc"] or not m["h"]):
        return None
    if m["h"] and not m["i"] and not m["ap"]:
        return None
    if m["iz"] and m["w"]:
        return None
    kind = "ymd" if m["y1"] else "num" if m["y2"] else "mon" if m["n3"] or m["n4"] else "compact"
    return {"m": m}, kind + (m["s1"] or m["s2"] or "") + ("p" if m["ap"] else "") + ("z" if m["z"] else "o" if m["o"] else "w" if m["w"] else "")


def read_shape(shape: str, texts: list[str], zones: list, orders: list, words: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """The readings of values of one shape: (microseconds, which values have it, form)."""
    found = layout(shape) if len(shape) <= 64 else layout.__wrapped__(shape)  # long shapes are read alike, but not remembered
    if found is None:
        return []
    at, form = found
    m, n = at["m"], len(texts)
    cells = np.frombuffer("".join(texts).encode("ascii"), np.uint8).reshape(n, len(shape)).astype(np.int64) - 48

    def span(i: int, j: int) -> np.ndarray:
        v = np.zeros(n, np.int64)
        for c in range(i, j):
            v = v * 10 + cells[:, c]
        return v

    def field(name: str) -> np.ndarray | None:
        return None if m[name] is None else span(*m.span(name))

    def micros(i: int, j: int) -> np.ndarray:
        return span(i, min(j, i + 6)) * 10 ** (6 - min(j - i, 6))

    yes = np.ones(n, bool)
    if "epoch" in at:
        if m.group(1):
            us = span(*m.span(1)) * 1_000_000 + (micros(*m.span(2)) if m.group(2) else 0)
        else:
            us = span(0, len(shape) if len(shape) < 19 else 16) * {13: 1000, 16: 1, 19: 1}[len(shape)]
        return [(us, yes, form)]

    if m["c"]:
        i = m.start("c")
        dates = [(span(i, i + 4), span(i + 4, i + 6), span(i + 6, i + 8), yes, "")]
    elif m["y1"]:
        dates = [(field("y1"), field("m1"), field("d1"), yes, "")]
    elif m["y2"]:
        y, a, b = field("y2"), field("a"), field("b")
        y = y + 2000 if len(m["y2"]) == 2 else y
        known = np.array([str(o or "").strip().upper() for o in orders])
        dates = [(y, b, a, known != "MDY", "dmy"), (y, a, b, known != "DMY", "mdy")]
    else:
        name = m["n3"] or m["n4"]
        y = field("y3") if m["n3"] else field("y4")
        y = y + 2000 if m["n3"] and len(m["y3"]) == 2 else y
        dates = [(y, np.full(n, MONTHS.index(name[:3]) + 1), field("d3") if m["n3"] else field("d4"), yes, "")]

    h = field("h") if m["h"] else field("hc")
    i, s = (field("i"), field("s")) if m["h"] else (field("ic"), field("sc"))
    i, s = np.zeros(n, np.int64) if i is None else i, np.zeros(n, np.int64) if s is None else s
    part = "f" if m["f"] else "fc"
    us = micros(*m.span(part)) if m[part] else np.zeros(n, np.int64)
    ok = (i < 60) & (s < 60)
    if m["ap"]:
        ok &= (h >= 1) & (h <= 12)
        h = h % 12 + (12 if m["ap"] == "p" else 0)
    ok &= h < 24

    out = []
    for y, mo, d, allowed, order in dates:
        day, is_date = days(y, mo, d)
        local = day * 86400 + h * 3600 + i * 60 + s
        good = ok & is_date & allowed
        if order == "mdy":  # one reading if day and month are the same
            good &= ~((d == mo) & dates[0][3])
        if not good.any():
            continue
        if m["z"]:
            pairs = [(local, yes)]
        elif m["o"]:
            oh, om = field("oh"), field("om")
            om = np.zeros(n, np.int64) if om is None else om
            shift = (oh * 3600 + om * 60) * (1 if m["o"] == "+" else -1)
            pairs = [(local - shift, (om < 60) & (oh * 60 + om <= 14 * 60))]
        elif m["w"]:
            pairs = [(local - words[m["w"]] * 60, yes)] if m["w"] in words else []
        elif m["iz"] or m["iz2"]:
            pairs = to_utc(local, _written_zone(m["iz"] or m["iz2"]))
        else:
            pairs = []
            for zone in {z for z in zones if z}:
                of = np.array([z == zone for z in zones])
                pairs += [(utc, there & of) for utc, there in to_utc(local, zone)]
        for utc, there in pairs:
            there = there & good & (utc >= _FIRST) & (utc <= _LAST)
            if there.any():
                out.append((utc * 1_000_000 + us, there, form + order))
    return out


@lru_cache(maxsize=1024)
def _written_zone(lower: str) -> str:
    """IANA names are compared without case here, since shapes are lower case."""
    return "/".join("_".join(x.capitalize() for x in part.split("_")) for part in lower.split("/"))


def interpret(raw: list, zones: list, orders: list, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """All readings of a batch: list offsets, instants, form codes, names of forms. Readings of a value are in ascending time."""
    groups: dict[str, list[int]] = {}
    plain: list[str] = [""] * len(raw)
    for k, v in enumerate(raw):
        if not v or not (v := v.strip()):
            continue
        if not v.isascii():
            v = v.translate(_PLAIN).strip()
            if not v.isascii():
                continue
        plain[k] = v = v.lower()
        groups.setdefault(v.translate(_TO_SHAPE), []).append(k)
    rows, instants, forms, names = [], [], [], {}
    for shape, ks in groups.items():
        for us, there, form in read_shape(shape, [plain[k] for k in ks], [zones[k] for k in ks], [orders[k] for k in ks], words):
            pick = np.flatnonzero(there)
            rows.append(np.array(ks)[pick])
            instants.append(us[pick])
            forms.append(np.full(len(pick), names.setdefault(form, len(names))))
    if not rows:
        return np.zeros(len(raw) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    row, us, form = np.concatenate(rows), np.concatenate(instants), np.concatenate(forms)
    order = np.lexsort((us, row))
    counts = np.bincount(row, minlength=len(raw))
    return np.concatenate([[0], np.cumsum(counts)]), us[order], form[order], list(names)


INTERPRETATIONS = "array<struct<utc_us:bigint,form:string>>"


def interpretations(words: dict[str, int], raw: Column, zone: Column, order: Column) -> Column:
    """array<struct<utc_us, form>> of every valid reading; `words` maps lower-case abbreviations to minutes east of UTC."""

    def read(raw: pa.Array, zone: pa.Array, order: pa.Array) -> pa.Array:
        offsets, us, form, names = interpret(raw.to_pylist(), zone.to_pylist(), order.to_pylist(), words)
        forms = pa.array(names, pa.string()).take(pa.array(form, pa.int32())) if len(form) else pa.array([], pa.string())
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(us, pa.int64()), forms], ["utc_us", "form"]))

    read.__annotations__ = {"raw": pa.Array, "zone": pa.Array, "order": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, INTERPRETATIONS)(raw, zone, order)


def single_instants(words: dict[str, int], raw: Column, zone: Column, order: Column) -> Column:
    """The instant in microseconds of values with exactly one reading, else null."""

    def read(raw: pa.Array, zone: pa.Array, order: pa.Array) -> pa.Array:
        offsets, us, _, _ = interpret(raw.to_pylist(), zone.to_pylist(), order.to_pylist(), words)
        one = np.diff(offsets) == 1
        at = np.minimum(offsets[:-1], max(len(us) - 1, 0))
        return pa.array(us[at] if len(us) else np.zeros(len(one), np.int64), pa.int64(), mask=~one)

    read.__annotations__ = {"raw": pa.Array, "zone": pa.Array, "order": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, "bigint")(raw, zone, order)

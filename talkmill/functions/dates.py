"""Written dates by a fixed list of formats, in order; the first that fits counts, and the wall clock is kept as written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: formats after ISO 8601, day before month first
FORMATS = (
    "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy", "d/M/yy H:m:s", "d/M/yy H:m", "d/M/yy", "d-M-yyyy H:m:s", "d-M-yyyy H:m", "d-M-yyyy",
    "d/M/yyyy h:m:s a", "d/M/yyyy h:m a", "d/M/yy h:m:s a", "d/M/yy h:m a", "M/d/yyyy H:m:s", "M/d/yyyy H:m",
)
ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?$"


def parsed(c: Column, custom: str | None = None) -> Column:
    """timestamp_ntz of a written date, null if no format fits; a custom format comes before the list."""
    t = F.trim(c)
    iso = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(t, ISO, 1), F.regexp_extract(t, ISO, 2)), F.lit("yyyy-MM-dd HH:mm:ss"))
    tries = [F.when(t.rlike(ISO), iso)]
    for f in ([custom] if custom else []) + list(FORMATS):
        year = r"\d{4}" if "yyyy" in f else r"\d{2}"
        shape = "^" + f.replace("yyyy", "Y").replace("yy", "Y").replace("a", "P").replace("d", "N").replace("M", "N").replace("H", "N").replace("h", "N").replace("m", "N").replace("s", "N") + "$"
        shape = shape.replace("N", r"\d{1,2}").replace("Y", year).replace("P", "[AaPp][Mm]")
        tries.append(F.when(t.rlike(shape), F.try_to_timestamp(F.upper(t), F.lit(f))) if f in FORMATS else F.try_to_timestamp(t, F.lit(f)))
    return F.coalesce(*tries).cast("timestamp_ntz")

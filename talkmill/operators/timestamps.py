"""Mixed timestamp formats and zones: one UTC instant per row.

Every value gets all its valid readings (`functions.instants`). Where there are several, one is chosen by Viterbi over
the record order of its source: switching the form costs SWITCH, going back in time costs up to BACK.

A source may hold any share of the rows, so rows are range-partitioned by source and position, and the walk is cut into blocks, one
for each partition a source reaches into. A block first gives the least cost from every reading of its first row to every
reading of its last; these tables are composed along a source (one small row for each block), which fixes the readings at the
ends of all blocks, and between its fixed ends each block then walks its own rows. So the choice is that of one walk over the
whole source, however it is cut.

Defined results: null, blank or unreadable values, unknown zones and skipped local hours have no reading (`n_readings` 0);
rows without source or position have no record order: with several readings they get no instant. Repeated rows and ties in
position are ordered by key. Columns other than those named are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.common import bounded_broadcast, lookup_rows, table, written
from talkmill.functions.instants import interpretations

SWITCH, BACK, HOUR = 1.0, 3.0, 3_600_000_000
LATER = 2e-11  # what a later reading costs beside an earlier one, so that ties go to the earlier


def zone_word_map(zone_words: DataFrame) -> dict[str, int]:
    """Lower-case abbreviation -> minutes east of UTC."""
    return {r[0].strip().lower(): int(r[1]) for r in lookup_rows(zone_words.select("abbreviation", "offset_minutes")) if r[0] and r[1] is not None}


def file_facts(source_files: DataFrame) -> DataFrame:
    """One row per file: what holds in it where nothing is written."""
    return source_files.filter("source_file is not null").groupBy(F.col("source_file").alias("_source")).agg(F.max("zone_name").alias("_zone"), F.max("date_order").alias("_order"))


def step(us_a: np.ndarray, form_a: np.ndarray, us_b: np.ndarray, form_b: np.ndarray) -> np.ndarray:
    """What it costs to go from each reading of a row to each of the next."""
    back = np.maximum(us_a[:, None] - us_b[None, :], 0) / HOUR
    return SWITCH * (form_a[:, None] != form_b[None, :]) + np.where(back > 0, np.minimum(BACK, 0.5 + np.log1p(back)), 0) + LATER * np.arange(len(us_b))


def choose(offsets: np.ndarray, us: np.ndarray, form: np.ndarray) -> np.ndarray:
    """Index into `us` of the chosen reading of each row in record order, -1 without any. Viterbi; ties go to the earlier reading.

    Rows with one reading separate the runs of rows with several, so only those runs are walked.
    """
    counts = np.diff(offsets)
    chosen = np.where(counts == 1, offsets[:-1], -1)
    some = np.flatnonzero(counts)
    if not (counts > 1).any():
        return chosen
    many = counts[some] > 1
    starts = np.flatnonzero(many & ~np.concatenate([[False], many[:-1]]))
    ends = np.flatnonzero(many & ~np.concatenate([many[1:], [False]]))
    span = lambda k: np.arange(offsets[some[k]], offsets[some[k] + 1])
    for first, last in zip(starts, ends):
        prev = span(first - 1) if first else None
        cost, trail = None, []
        for k in range(first, last + 1):
            here = span(k)
            if prev is None:
                cost, ptr = LATER * np.arange(len(here)), None
            else:
                total = (0 if cost is None else cost[:, None]) + step(us[prev], form[prev], us[here], form[here])
                ptr = total.argmin(axis=0)
                cost = total[ptr, np.arange(len(here))]
            trail.append((here, ptr))
            prev = here
        if last + 1 < len(some):
            after = span(last + 1)
            cost = cost + step(us[prev], form[prev], us[after], form[after])[:, 0]
        j = int(cost.argmin())
        for k in range(last, first - 1, -1):
            here, ptr = trail[k - first]
            chosen[some[k]] = here[j]
            j = 0 if ptr is None else int(ptr[j])
    return chosen


def across(offsets: np.ndarray, us: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The readings of the first and of the last row that has any, and the least cost from each of those to each of these.

    Between the first and the last row with one reading the cost is the same for all, and is left out.
    """
    counts = np.diff(offsets)
    some = np.flatnonzero(counts)
    if not len(some):
        return None
    span = lambda k: np.arange(offsets[some[k]], offsets[some[k] + 1])

    def walk(rows: range) -> np.ndarray:
        at = span(rows[0])
        cost = np.where(np.eye(len(at)) > 0, 0.0, np.inf)
        for k in rows[1:]:
            here = span(k)
            cost = (cost[:, :, None] + step(us[at], form[at], us[here], form[here])[None]).min(axis=1)
            at = here
        return cost

    single = np.flatnonzero(counts[some] == 1)
    if len(single):
        table_ = walk(range(0, single[0] + 1))[:, :1] + walk(range(single[-1], len(some)))[:1]
    else:
        table_ = walk(range(len(some)))
    return span(0), span(len(some) - 1), table_


def _sorted(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.Array]:
    """A block in record order, list offsets, instants and forms of its readings."""
    group = group.combine_chunks().sort_by([("_pos", "ascending"), ("_key", "ascending")])
    readings = group["_readings"].chunk(0) if group.num_rows else pa.array([], group.schema.field("_readings").type)
    offsets = np.asarray(readings.offsets)
    flat = readings.flatten()
    return group, offsets - offsets[0], np.asarray(flat.field(0)), flat.field(1)


def _codes(form: pa.Array) -> np.ndarray:
    return np.asarray(form.dictionary_encode().indices) if len(form) else np.zeros(0, np.int64)


ENDS = "_source string, _part int, first_us array<bigint>, first_form array<string>, last_us array<bigint>, last_form array<string>, cost array<double>"


def _ends(group: pa.Table) -> pa.Table:
    group, offsets, us, form = _sorted(group)
    got = across(offsets, us, _codes(form))
    schema = pa.schema([("_source", pa.string()), ("_part", pa.int32()), *((n, pa.list_(t)) for n, t in (("first_us", pa.int64()), ("first_form", pa.string()), ("last_us", pa.int64()), ("last_form", pa.string()), ("cost", pa.float64())))])
    if got is None:
        return schema.empty_table()
    first, last, cost = got
    names = lambda at: form.take(pa.array(at)).to_pylist()
    return pa.table([[group["_source"][0].as_py()], [group["_part"][0].as_py()], [us[first].tolist()], [names(first)], [us[last].tolist()], [names(last)], [cost.reshape(-1).tolist()]], schema=schema)


def _compose(blocks: pa.Table) -> pa.Table:
    """The blocks of a source: which reading of its first and of its last row each takes."""
    rows = sorted(blocks.to_pylist(), key=lambda r: r["_part"])
    forms = {f: k for k, f in enumerate({f for r in rows for f in (*r["first_form"], *r["last_form"])})}
    code = lambda names: np.array([forms[f] for f in names])
    total, trail = None, []
    for k, r in enumerate(rows):
        n = len(r["first_us"])
        inner = np.array(r["cost"]).reshape(n, -1)
        if total is None:
            enter, back = LATER * np.arange(n), np.zeros(n, np.int64)
        else:
            last = rows[k - 1]
            both = total[:, None] + step(np.array(last["last_us"]), code(last["last_form"]), np.array(r["first_us"]), code(r["first_form"]))
            back = both.argmin(axis=0)
            enter = both[back, np.arange(n)]
        both = enter[:, None] + inner
        trail.append((back, both.argmin(axis=0)))
        total = both.min(axis=0)
    j, picks = int(total.argmin()), []
    for back, into in reversed(trail):
        i = int(into[j])
        picks.append((i, j))
        j = int(back[i])
    picks.reverse()
    return pa.table({"_source": pa.array([r["_source"] for r in rows], pa.string()), "_part": pa.array([r["_part"] for r in rows], pa.int32()), "first": pa.array([p[0] for p in picks], pa.int32()), "last": pa.array([p[1] for p in picks], pa.int32())})


def _decide(group: pa.Table, ends: pa.Table) -> pa.Table:
    """The choice in a block between its fixed ends."""
    group, offsets, us, form = _sorted(group)
    counts = np.diff(offsets)
    keep = np.ones(len(us), bool)
    some = np.flatnonzero(counts)
    if len(some):
        for row, pick in ((some[0], ends["first"][0].as_py()), (some[-1], ends["last"][0].as_py())):
            if counts[row] > 1:
                keep[offsets[row] : offsets[row + 1]] = np.arange(counts[row]) == pick
    kept = np.flatnonzero(keep)
    now = np.concatenate([[0], np.cumsum(np.add.reduceat(np.append(keep, False).astype(np.int64), offsets[:-1]) * (counts > 0))]) if len(counts) else np.zeros(1, np.int64)
    at = choose(now, us[kept], _codes(form)[kept])
    none = at < 0
    pick = kept[np.where(none, 0, at)] if len(kept) else np.zeros(len(at), np.int64)
    chosen = pa.array(us[pick] if len(us) else np.zeros(len(at), np.int64), pa.int64(), mask=none)
    forms = form.take(pa.array(pick, pa.int64(), mask=none)) if len(us) else pa.nulls(len(at), pa.string())
    return pa.table({"key": group["_key"], "utc_us": chosen, "form": forms, "n_readings": pa.array(counts, pa.int32()), "fallback_us": group["_fallback_us"]})


def utc_text(us: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.ffffffZ of microseconds since 1970, whatever the session's zone."""
    day = F.timestamp_add("MICROSECOND", us, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))) 
    return F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def normalise(df: DataFrame, source_files: DataFrame, zone_words: DataFrame, *, key: str, raw: str, source: Column | str, position: Column | str, fallback: str | None = None, blocks: int | None = None) -> DataFrame:
    """One row per input row: key, utc_us, form, n_readings (of `raw`), fallback_us.

    `utc_us` is the chosen reading of `raw`; `fallback_us` is the instant of `fallback` if that carries Z or an offset. `blocks` is
    the number of range partitions; it has no influence on the result.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    words = zone_word_map(zone_words)
    rows = df.select(F.col(key).cast("bigint").alias("_key"), F.col(raw).cast("string").alias("_raw"), as_col(source).alias("_source"), as_col(position).cast("bigint").alias("_pos"), (F.col(fallback).cast("string") if fallback else F.lit(None).cast("string")).alias("_fall"))
    n = blocks or max(df.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    # laid out before values are read, so that each is read once; rows without record order spread by their key
    rows = rows.withColumn("_loose", F.col("_source").isNull() | F.col("_pos").isNull())
    rows = rows.repartitionByRange(n, "_loose", F.when(~F.col("_loose"), F.col("_source")), F.when(~F.col("_loose"), F.col("_pos")), "_key").withColumn("_part", F.spark_partition_id())
    rows = rows.join(bounded_broadcast(file_facts(source_files)), "_source", "left")
    none = F.lit(None).cast("string")
    rows = rows.withColumn("_readings", interpretations(words, F.col("_raw"), F.col("_zone"), F.col("_order"))).withColumn("_back", interpretations({}, F.when(F.col("_fall").rlike(r"(?i)(z|[+\-\x{2212}]\d{1,2}:?(\d{2})?)(\[[^\]]*\])?\s*$"), F.col("_fall")), none, none))
    laid = written(rows.select("_key", "_source", "_pos", "_part", "_loose", "_readings", F.when(F.size("_back") == 1, F.col("_back")[0]["utc_us"]).alias("_fallback_us")))
    single = lambda c: F.when(F.size("_readings") == 1, F.col("_readings")[0][c])
    loose = laid.filter("_loose").select(F.col("_key").alias("key"), single("utc_us").alias("utc_us"), single("form").alias("form"), F.size("_readings").alias("n_readings"), F.col("_fallback_us").alias("fallback_us"))
    held = laid.filter("not _loose").drop("_loose")
    ends = held.drop("_fallback_us").groupBy("_source", "_part").applyInArrow(_ends, ENDS)
    fixed = ends.groupBy("_source").applyInArrow(_compose, "_source string, _part int, first int, last int")
    chosen = held.groupBy("_source", "_part").cogroup(fixed.groupBy("_source", "_part")).applyInArrow(_decide, "key bigint, utc_us bigint, form string, n_readings int, fallback_us bigint")
    return chosen.unionByName(loose)


def resolved(df: DataFrame) -> DataFrame:
    """`normalise` with the fallback taken where the raw value gives no instant of its own: key, utc_us, origin, form."""
    one = F.col("n_readings") == 1
    return df.select("key", F.when(one, F.col("utc_us")).otherwise(F.col("fallback_us")).alias("utc_us"), F.when(one, F.lit("raw")).when(F.col("fallback_us").isNotNull(), F.lit("fallback")).alias("origin"), "form")


def syn_normalised(spark, sf_dir: str) -> DataFrame:
    return normalise(table(spark, sf_dir, "syn_020"), table(spark, sf_dir, "source_files"), table(spark, sf_dir, "zone_words"), key="turn_id", raw="timestamp_raw", source=F.col("provenance.source_file"), position=F.col("provenance.source_row"), fallback="timestamp")


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Turns with exactly one instant."""
    return resolved(syn_normalised(spark, sf_dir)).filter("utc_us is not null").select(F.col("key").alias("turn_id"), utc_text(F.col("utc_us")).alias("utc_time"))


def p6_chosen(spark, sf_dir: str) -> DataFrame:
    """Every turn with the instant chosen in its record order, also where the raw value alone has several readings."""
    n = syn_normalised(spark, sf_dir)
    return n.select(F.col("key").alias("turn_id"), utc_text(F.coalesce("utc_us", "fallback_us")).alias("utc_time"), "n_readings", "form")

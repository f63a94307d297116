"""Separated-value records: typed rows, and the records that cannot be loaded with the reason.

Structural indexing over a batch: all records of one separator lie in one byte buffer. A mask of the quote signs, its
prefix parity within each record and the mask of separators give the fields of every record whose quotes all stand at the
ends of fields. Records with other quotes (plain text in an unquoted field, doubled signs, open quotes) are walked field by
field, all of them at once, with the ends of quoted fields looked up among the quote runs of odd length.

`read_records` finds the records of raw files first: whether a line break ends a record depends on whether a quoted field is open
there. For each line of a block the state after it is worked out for both states before it; these maps are composed within blocks
and from block to block of a file, so a file is cut at will and a quoted field may reach over any number of lines and blocks.

Defined results: a null or blank record is `column_count`; a leading byte-order mark and a trailing carriage return are no
data; records of unknown files are read with DEFAULT_SEP; repeated rows are judged alike; a turn beyond int
loads as null and stands as written in turn_index_text, which is null for all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.common import bounded_broadcast, spread, table, trimmed

FIELDS = ("item_id", "conversation_id", "turn_index", "user_message", "action", "reply", "labeler")
DEFAULT_SEP = ","
QUOTE = 34


def split_records(texts: list[str], sep: str) -> tuple[np.ndarray, list[list[str]]]:
    """For each record: whether its quoting is broken, and its fields (unquoted)."""
    broken, _, bounds, raw = structure(texts, sep)
    return broken, [[raw[p + 1 : c - 1].decode(errors="replace").replace('""', '"') if q else raw[p:c].decode(errors="replace") for p, c, q in b] for b in bounds]


def left_open(texts: list[str], sep: str) -> np.ndarray:
    """Whether a quoted field is still open at the end of each text."""
    return structure(texts, sep)[1]


def structure(texts: list[str], sep: str) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, bool]]], bytes]:
    """For each text: whether its quoting is broken, whether because a field is not closed, its fields as (start, end, quoted), and the bytes they lie in."""
    n = len(texts)
    data = [t.encode() for t in texts]
    length = np.array([len(d) for d in data], np.int64)
    end = np.cumsum(length + 1) - 1
    start = end - length
    buf = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    quote = buf == QUOTE
    delim = buf == ord(sep)
    delim[end] = True  # a record's end closes its last field
    first = np.zeros(len(buf), bool)
    first[start] = True
    opens_ok = first | np.concatenate([[False], delim[:-1]])
    count = np.cumsum(quote)
    before = np.where(start > 0, count[np.maximum(start - 1, 0)], 0)
    of = np.repeat(np.arange(n), length + 1)
    parity = (count - before[of]) & 1
    # quote signs in even places open, in odd places close; each opening must begin a field and each closing end one
    opening, closing = quote & (parity == 1), quote & (parity == 0)
    ends_ok = np.concatenate([delim[1:], [True]])
    odd = np.zeros(n, bool)
    odd[of[opening & ~opens_ok]] = True
    odd[of[closing & ~ends_ok]] = True
    odd[of[end[parity[end] == 1]]] = True
    broken, opened = np.zeros(n, bool), np.zeros(n, bool)
    bounds: list[list[tuple[int, int, bool]]] = [[] for _ in range(n)]
    cut = np.flatnonzero(delim & (parity == 0) & ~odd[of])
    prev = np.maximum(np.concatenate([[-1], cut[:-1]]) + 1, start[of[cut]])[: len(cut)]
    for p, c, r in zip(prev.tolist(), cut.tolist(), of[cut].tolist()):
        bounds[r].append((p, c, p < c and bool(quote[p])))
    if odd.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], quote.view(np.int8), [0]])))
        run_start, run_end = edge[::2], edge[1::2]
        is_odd = ((run_end - run_start) & 1) == 1
        odd_start, odd_end = run_start[is_odd], run_end[is_odd]
        seps = np.flatnonzero(delim)
        live = np.flatnonzero(odd)
        at = start[live]
        while len(live):
            quoted = quote[at] & (at < end[live])
            stop = seps[np.searchsorted(seps, at)]
            inner = at + 1
            k = np.searchsorted(run_end, inner, side="right")
            kk = np.minimum(k, max(len(run_start) - 1, 0))
            in_run = (k < len(run_start)) & (run_start[kk] <= inner) if len(run_start) else np.zeros(len(at), bool)
            rest = np.where(in_run, run_end[kk] - inner, 0)
            here = in_run & (rest % 2 == 1)
            after = np.where(in_run, run_end[kk], inner)
            j = np.searchsorted(odd_start, after)
            far = np.where(j < len(odd_end), odd_end[np.minimum(j, max(len(odd_end) - 1, 0))] if len(odd_end) else 0, len(buf))
            close = np.where(here, run_end[kk], far) - 1  # place of the closing sign
            bad = quoted & ((close >= end[live]) | ~delim[np.minimum(close + 1, len(buf) - 1)])
            stop = np.where(quoted & ~bad, close + 1, stop)
            broken[live[bad]] = True
            opened[live[quoted & (close >= end[live])]] = True
            for r, p, c, q in zip(live[~bad].tolist(), at[~bad].tolist(), stop[~bad].tolist(), quoted[~bad].tolist()):
                bounds[r].append((p, c, q))
            go = ~bad & (stop < end[live])
            live, at = live[go], stop[go] + 1
    return broken, opened, bounds, buf.tobytes()


def _index(lines: pa.Array, seps: pa.Array) -> pa.Array:
    lines, seps = lines.to_pylist(), seps.to_pylist()
    broken, fields = [False] * len(lines), [None] * len(lines)
    groups: dict[str, list[int]] = {}
    for k, (line, sep) in enumerate(zip(lines, seps)):
        if line is not None and (line := line.removeprefix("﻿").removesuffix("\r")).strip():
            lines[k] = line
            groups.setdefault(sep, []).append(k)
    for sep, ks in groups.items():
        bad, found = split_records([lines[k] for k in ks], sep)
        for k, b, f in zip(ks, bad.tolist(), found):
            broken[k], fields[k] = b, None if b else f
    return pa.StructArray.from_arrays([pa.array(broken, pa.bool_()), pa.array(fields, pa.list_(pa.string()))], ["broken", "fields"])


_index.__annotations__ = {"lines": pa.Array, "seps": pa.Array, "return": pa.Array}


def indexed(line: Column, sep: Column) -> Column:
    """struct<broken, fields> of a record; fields is null for broken, null and blank records."""
    return F.arrow_udf(_index, "struct<broken:boolean,fields:array<string>>")(line, sep)


def _after(sep: str):
    """The states after each line: if no quoted field was open before it, and if one was."""

    def states(lines: pa.Array) -> pa.Array:
        texts = [x.removesuffix("\r") for x in lines.fill_null("").to_pylist()]
        plain, inside = left_open(texts, sep), left_open([f'"{x}' for x in texts], sep)
        return pa.StructArray.from_arrays([pa.array(plain), pa.array(inside)], ["plain", "inside"])

    states.__annotations__ = {"lines": pa.Array, "return": pa.Array}
    return F.arrow_udf(states, "struct<plain:boolean,inside:boolean>")


def read_records(spark, path: str, sep: str = DEFAULT_SEP) -> DataFrame:
    """(source_file, block, line, raw_line) of the records of raw files below a path; block and line say where a record begins.

    A file is read in splits. A record holds its line breaks; one whose quoted field is never closed reaches to the next quote sign
    or the end of its file. Empty files have no record; the last line break of a file is no data.
    """
    from talkmill.common import written

    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value"))
    laid = written(lines.withColumn("x", _after(sep)(F.col("value"))))
    fixed, swaps = F.col("x.plain") == F.col("x.inside"), (F.col("x.plain") & ~F.col("x.inside")).cast("int")
    w = W.partitionBy("file", "block").orderBy("id")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    odd = lambda c: c % 2 == 1
    rows = laid.withColumn("n", F.sum(swaps).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("n0", F.coalesce(F.sum(swaps).over(past), F.lit(0))).withColumn("k", F.last(F.when(fixed, F.struct(F.col("x.plain").alias("v"), "n")), ignorenulls=True).over(past))
    # the state before a line is known from the block, or is that before the block, turned `flip` times
    rows = rows.withColumn("known", F.when(F.col("k").isNotNull(), F.col("k.v") != odd(F.col("n0") - F.col("k.n")))).withColumn("flip", odd(F.col("n0")))
    end = F.when(fixed, F.struct(F.col("x.plain").alias("v"), F.lit(False).alias("flip"))).otherwise(F.struct((F.col("known") != odd(swaps)).alias("v"), (F.col("flip") != odd(swaps)).alias("flip")))
    ends = rows.groupBy("file", "block").agg(F.max_by(end, "id").alias("e"))
    over = W.partitionBy("file").orderBy("block")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("s", F.sum(F.when(F.col("e.v").isNull(), F.col("e.flip").cast("int")).otherwise(0)).over(over.rowsBetween(W.unboundedPreceding, 0)))
    ends = ends.withColumn("s0", F.coalesce(F.sum(F.when(F.col("e.v").isNull(), F.col("e.flip").cast("int")).otherwise(0)).over(before), F.lit(0))).withColumn("k", F.last(F.when(F.col("e.v").isNotNull(), F.struct(F.col("e.v").alias("v"), "s")), ignorenulls=True).over(before))
    ends = written(ends.select("file", "block", F.when(F.col("k").isNull(), odd(F.col("s0"))).otherwise(F.col("k.v") != odd(F.col("s0") - F.col("k.s"))).alias("open")))  # a row for each split
    begun = rows.join(ends, ["file", "block"]).withColumn("begins", ~F.coalesce("known", F.col("open") != F.col("flip"))).select("file", "block", "id", "value", "begins")
    begun = written(begun.withColumn("of", F.max(F.when(F.col("begins"), F.struct("block", "id"))).over(w)).withColumn("alone", F.col("begins") & F.coalesce(F.lead("begins").over(w), F.lit(False))))
    firsts = begun.groupBy("file", "block").agg(F.max(F.when(F.col("begins"), F.struct("block", "id"))).alias("m")).withColumn("carried", F.last("m", ignorenulls=True).over(before)).select("file", "block", "carried")
    rest = begun.filter("not alone").join(firsts, ["file", "block"]).withColumn("of", F.coalesce("of", "carried"))
    joined = rest.groupBy("file", "of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "value"))), lambda x: x["value"]), "\n").alias("raw_line"))
    out = begun.filter("alone").select("file", "block", "id", F.col("value").alias("raw_line")).unionByName(joined.select("file", F.col("of.block").alias("block"), F.col("of.id").alias("id"), "raw_line"))
    return out.select(F.element_at(F.split("file", "/"), -1).alias("source_file"), "block", F.col("id").alias("line"), "raw_line")


def load_records(lines: DataFrame, source_files: DataFrame, action_catalog: DataFrame, *, key: str = "line_id", line: str = "raw_line", source: str = "source_file") -> DataFrame:
    """One row per record: key, source_file, the seven typed fields, and `reason` (null for rows that load)."""
    seps = source_files.filter("source_file is not null").groupBy(F.col("source_file").alias("_source")).agg(F.max(F.when(F.length("field_sep") == 1, F.col("field_sep"))).alias("_sep"))
    known = action_catalog.select(F.lower(trimmed("action_name")).alias("_known")).filter("_known is not null").distinct()
    rows = spread(lines.select(F.col(key).alias("_key"), F.col(line).alias("_line"), F.col(source).alias("_source"))).join(bounded_broadcast(seps), "_source", "left")
    rows = rows.withColumn("_x", indexed(F.col("_line"), F.coalesce("_sep", F.lit(DEFAULT_SEP)))).select("_key", "_source", "_x")
    f = lambda k: F.col("_x.fields")[k]
    rows = rows.withColumn("_full", F.size("_x.fields") == len(FIELDS))
    rows = rows.select("_key", "_source", F.col("_x.broken").alias("_broken"), F.coalesce("_full", F.lit(False)).alias("_full"), *[F.when(F.col("_full"), f(k)).alias(f"_{name}") for k, name in enumerate(FIELDS)])
    rows = rows.withColumn("_act", F.lower(trimmed("_action"))).join(bounded_broadcast(known), F.col("_act") == F.col("_known"), "left")
    turn = trimmed("_turn_index")
    wrong = (trimmed("_conversation_id") == "") | (trimmed("_user_message") == "") | ~turn.rlike(r"^[0-9]*$") | ((F.col("_act") != "") & F.col("_known").isNull())
    wrong = wrong | F.col("_user_message").rlike(r"[\x{fffd}\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}]")
    reason = F.when(F.col("_broken"), "quoting").when(~F.col("_full"), "column_count").when(wrong, "value")
    load = reason.isNull()
    typed = {
        "item_id": F.nullif(trimmed("_item_id"), F.lit("")), "conversation_id": trimmed("_conversation_id"), "turn_index": turn.try_cast("int"), "turn_index_text": F.when((turn != "") & turn.try_cast("int").isNull(), turn), "user_message": F.col("_user_message"),
        "action": F.nullif(F.col("_act"), F.lit("")), "reply": F.nullif(trimmed("_reply"), F.lit("")), "labeler": F.nullif(trimmed("_labeler"), F.lit("")),
    }
    return rows.select(F.col("_key").alias(key), F.col("_source").alias("source_file"), *[F.when(load, c).alias(n) for n, c in typed.items()], reason.alias("reason"))


def sheet_records(spark, sf_dir: str) -> DataFrame:
    return load_records(table(spark, sf_dir, "sheet_lines"), table(spark, sf_dir, "source_files"), table(spark, sf_dir, "action_catalog"))


def p7_found(spark, sf_dir: str) -> DataFrame:
    return sheet_records(spark, sf_dir).filter("reason is not null").select("line_id", "reason")


def p7_files(spark, sf_dir: str) -> DataFrame:
    """The loaded rows written as raw files with quoted line breaks, and found in them again."""
    import uuid

    from talkmill.common import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    rows = sheet_records(spark, sf_dir).filter("reason is null").select(*FIELDS)
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    lines = read_records(spark, path).withColumn("key", F.concat_ws(":", "source_file", "block", "line"))
    return load_records(lines, table(spark, sf_dir, "source_files").limit(0), table(spark, sf_dir, "action_catalog"), key="key").filter("reason is null").select(*FIELDS)


def p7_loaded(spark, sf_dir: str) -> DataFrame:
    return sheet_records(spark, sf_dir).filter("reason is null").drop("reason")

"""Rebuilding conversations from message rows.

A conversation is read as a word over three signs, in true time: C (customer content), A (agent content), X (content without
instant or side, or of a speaker on both sides). A finite-state automaton with the states below gives its verdict.

Rows are range-partitioned by (conversation, instant) and sorted there, so a conversation of any size spreads over tasks.
Each task runs the automaton from all states at once: what it emits for its part of a conversation is a map from states to
states. These maps compose in order, at most one for each task a conversation reaches into. X breaks a conversation wherever it
stands, so its rows are only counted, map-side. Joins by conversation or speaker take those of very many rows apart.

Defined results: rows with null or blank ids belong to no conversation; unknown role words say nothing; a row without role
takes the side its speaker has elsewhere in the conversation (customer or agent before system); at one instant agents come
before customers, as a reply must be later; repeated rows count as they stand; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.common import bounded_broadcast, join_hot, norm_id, numbered, spread, table, trimmed, written
from talkmill.functions.instants import single_instants
from talkmill.operators.timestamps import file_facts, utc_text, zone_word_map

EMPTY, NO_CUSTOMER, WAITING, ANSWERED, BROKEN = range(5)
#: Sign -> the state after it, by the state before it.
NEXT = np.array(
    [
        [NO_CUSTOMER, NO_CUSTOMER, ANSWERED, ANSWERED, BROKEN],  # A
        [WAITING, WAITING, WAITING, ANSWERED, BROKEN],  # C
        [BROKEN] * 5,  # X
    ],
    np.int8,
)
A, C, X = range(3)
PLACEHOLDER = r"^[\s\x{00a0}\x{feff}]*(\[[^\[\]]*\][\s\x{00a0}\x{feff}]*)?$"


def compose_runs(run: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """The composed map of each run of equal, ascending run numbers; halves the number of maps in every pass."""
    while len(run) > 1 and (run[1:] == run[:-1]).any():
        first = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1])
        place = np.arange(len(run)) - np.repeat(first, np.diff(np.concatenate([first, [len(run)]])))
        left = np.flatnonzero(place % 2 == 0)
        right = np.minimum(left + 1, len(run) - 1)
        pair = (right > left) & (run[right] == run[left])
        out = maps[left].copy()
        out[pair] = np.take_along_axis(maps[right[pair]], out[pair].astype(np.int64), axis=1)
        run, maps = run[left], out
    return maps


def _automaton(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, at, sign) rows -> (conv, at, map): one row for each conversation in this partition."""
    held: tuple | None = None  # conversation, its first instant here, its map so far
    schema = pa.schema([("conv", pa.string()), ("at", pa.int64()), ("map", pa.list_(pa.int8()))])

    def out(convs: list, ats: list, maps: np.ndarray) -> pa.RecordBatch:
        flat = pa.array(maps.reshape(-1), pa.int8())
        return pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(ats, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(convs) + 1) * 5, pa.int32()), flat)], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        code = np.asarray(b.column("conv").dictionary_encode().indices)
        change = np.concatenate([[True], code[1:] != code[:-1]])
        starts = np.flatnonzero(change)
        maps = compose_runs(np.cumsum(change), NEXT[np.asarray(b.column("sign"))])
        convs, ats = b.column("conv").take(pa.array(starts)).to_pylist(), b.column("at").take(pa.array(starts)).to_pylist()
        if held and held[0] == convs[0]:
            maps[0] = maps[0][held[2].astype(np.int64)]
            ats[0] = held[1]
        elif held:
            yield out([held[0]], [held[1]], held[2][None, :])
        if len(convs) > 1:
            yield out(convs[:-1], ats[:-1], maps[:-1])
        held = (convs[-1], ats[-1], maps[-1].copy())
    if held:
        yield out([held[0]], [held[1]], held[2][None, :])


def sided(messages: DataFrame, role_words: DataFrame, source_files: DataFrame, zone_words: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of conversations: conv, speaker, side by the row's own role, filled (text says something), at (microseconds UTC)."""
    roles = role_words.select(F.lower(trimmed("word")).alias("_word"), F.lower(trimmed("side")).alias("_side")).filter("_word is not null").dropDuplicates(["_word"])
    rows = messages.select(
        norm_id("source_conversation_id").alias("conv"), F.col("speaker"), F.lower(trimmed("role")).alias("_word"), F.col("timestamp_raw").alias("_raw"), F.col("source_file").alias("_source"),
        (F.col("text").isNotNull() & ~F.col("text").rlike(PLACEHOLDER)).alias("filled"), *[F.col(c).alias(f"keep_{c}") for c in keep],
    ).filter("conv is not null")
    rows = spread(rows).join(bounded_broadcast(roles), "_word", "left").join(bounded_broadcast(file_facts(source_files)), "_source", "left")
    at = single_instants(zone_word_map(zone_words), F.col("_raw"), F.col("_zone"), F.col("_order"))
    return rows.select("conv", "speaker", F.col("_side").alias("side"), "filled", at.alias("at"), *[f"keep_{c}" for c in keep])


def speaker_sides(rows: DataFrame) -> DataFrame:
    """(conv, speaker) -> on which sides the speaker's roles put it, whether it has content there or without role, and its rows without role."""
    on = lambda s: F.max((F.col("side") == s) & F.col("side").isNotNull())
    return rows.filter("speaker is not null").groupBy("conv", "speaker").agg(
        on("customer").alias("c"), on("agent").alias("a"), on("system").alias("s"), F.max(F.col("filled") & (F.coalesce("side", F.lit("")) != "system")).alias("says"), F.count_if(F.col("side").isNull()).alias("open")
    )


def _other_side() -> Column:
    """The side a speaker's other rows give."""
    return F.when(F.col("c") & ~F.col("a"), "customer").when(F.col("a") & ~F.col("c"), "agent").when(F.col("s") & ~F.col("a") & ~F.col("c"), "system")


def with_sides(rows: DataFrame, speakers: DataFrame) -> DataFrame:
    """Rows with the side that their role or else their speaker's other rows give. Only rows without own side are joined."""
    known = rows.filter("side is not null or speaker is null")
    who = F.struct("conv", "speaker").alias("_who")
    rest = join_hot(rows.filter("side is null and speaker is not null").withColumn("_who", who), speakers.filter("open > 0").select(who, _other_side().alias("_side"), "open"), "_who", "open")
    return known.unionByName(rest.withColumn("side", F.col("_side")).drop("_side", "_who"))


def verdicts(rows: DataFrame, speakers: DataFrame | None = None) -> DataFrame:
    """conversation -> state of the automaton after all its rows, and how many rows it has. `rows` as from `sided`, `speakers` as from `speaker_sides`."""
    speakers = speaker_sides(rows) if speakers is None else speakers
    told = with_sides(rows.select("conv", "speaker", "side", "filled", "at"), speakers)
    content = told.filter(F.col("filled") & (F.coalesce("side", F.lit("")) != "system"))
    sign = F.when(F.col("at").isNull() | F.col("side").isNull(), X).when(F.col("side") == "agent", A).when(F.col("side") == "customer", C).otherwise(X)
    signs = content.select("conv", "at", sign.cast("int").alias("sign"))
    zero = F.lit(0).cast("bigint").alias("n")
    ordered = signs.filter(F.col("sign") != X).select("conv", (F.col("at") * 4 + F.col("sign")).alias("at"), "sign")  # agents first at one instant
    parts = ordered.repartitionByRange("conv", "at").sortWithinPartitions("conv", "at").mapInArrow(_automaton, "conv string, at bigint, map array<tinyint>").select("*", zero)
    always = F.array(*[F.lit(BROKEN).cast("tinyint")] * 5).alias("map")
    broken = signs.filter(F.col("sign") == X).select("conv").unionByName(speakers.filter("c and a and says").select("conv")).distinct().select("conv", F.lit(2**62).alias("at"), always, zero)
    nothing = rows.groupBy("conv").agg(F.count("*").alias("n")).select("conv", F.lit(-(2**63) + 1).alias("at"), F.array(*[F.lit(k).cast("tinyint") for k in range(5)]).alias("map"), "n")
    merged = parts.unionByName(broken).unionByName(nothing).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "map"))).alias("parts"), F.sum("n").alias("n"))
    state = F.aggregate("parts", F.lit(EMPTY).cast("tinyint"), lambda s, p: F.element_at(p["map"], s.cast("int") + 1))
    return merged.select("conv", state.alias("state"), "n")


REASON = {EMPTY: "empty", BROKEN: "broken", NO_CUSTOMER: "no_reply", WAITING: "no_reply"}


def _message_rows(spark, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Written once, since the automaton, the speakers and the list of conversations all read it."""
    return written(sided(table(spark, sf_dir, "messages"), table(spark, sf_dir, "role_words"), table(spark, sf_dir, "source_files"), table(spark, sf_dir, "zone_words"), keep))


def dropped(rows: DataFrame) -> DataFrame:
    """Conversations to drop, with the reason."""
    reason = F.when(F.col("state") == ANSWERED, None)
    for state, word in REASON.items():
        reason = reason.when(F.col("state") == state, word)
    return verdicts(rows).select(F.col("conv").alias("source_conversation_id"), reason.alias("reason")).filter("reason is not null")


def rebuild(rows: DataFrame) -> DataFrame:
    """The turns of kept conversations in true time, numbered from 0 with customer and agent turns; system notes come with turn null.

    `rows` as from `sided` with message_id, source_row and text kept.
    """
    speakers = written(speaker_sides(rows))
    kept = written(verdicts(rows, speakers).filter(F.col("state") == ANSWERED).select("conv", "n"))
    told = written(join_hot(with_sides(rows, speakers), kept, "conv", "n"))  # turns and notes both read it
    said = told.filter(F.col("filled") & F.col("side").isin("customer", "agent")).withColumn("_rank", (F.col("side") == "customer").cast("int"))
    turns = numbered(said, "conv", ["at", "_rank", "keep_source_row", "keep_message_id"], "turn")
    notes = told.filter(F.col("side") == "system").withColumn("turn", F.lit(None).cast("bigint"))
    cols = ["conv", "turn", "side", "speaker", "at", "keep_message_id", "keep_text"]
    both = turns.select(*cols).unionByName(notes.select(*cols))
    return both.select(F.col("conv").alias("source_conversation_id"), "turn", F.col("side").alias("role"), "speaker", utc_text(F.col("at")).alias("utc_time"), F.col("keep_message_id").alias("message_id"), F.col("keep_text").alias("text"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    return dropped(_message_rows(spark, sf_dir))


def p3_turns(spark, sf_dir: str) -> DataFrame:
    return rebuild(_message_rows(spark, sf_dir, ("message_id", "source_row", "text")))

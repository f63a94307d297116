"""Selecting and shaping raw message rows: ranges, kinds, placeholders, roles, floors, global order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: hints that a table holds messages
NAME_HINTS = ("message", "chat", "conversation", "whatsapp", "dialog", "turn")
TEXT_HINTS, TIME_HINTS, WHO_HINTS = ("body", "text", "message", "content"), ("time", "date", "created", "sent", "ts"), ("sender", "speaker", "from", "user", "role", "direction", "author")


def in_range(at: Column, since: datetime | None = None, until: datetime | None = None) -> Column:
    """From `since` on, before `until`; a missing bound is open. Null times are outside of a given range."""
    out = F.lit(True)
    if since is not None:
        out = out & (at >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        out = out & (at < F.lit(until).cast("timestamp_ntz"))
    return out


def kept(kind: Column, body: Column, kinds: tuple[str, ...], text_kinds: tuple[str, ...]) -> Column:
    """Rows of kept kinds; those of text kinds need a body that isn't blank."""
    return kind.isin(*kinds) & (~kind.isin(*text_kinds) | (F.trim(F.coalesce(body, F.lit(""))) != ""))


def projected(kind: Column, body: Column, text_kinds: tuple[str, ...], placeholders: dict[str, str]) -> Column:
    """The body for text kinds, the fixed placeholder for others; kinds of neither sort come out null."""
    out = F.when(kind.isin(*text_kinds), body)
    for k, text in placeholders.items():
        out = out.when(kind == k, F.lit(text))
    return out


def unclassified(rows: DataFrame, kind: str, known: tuple[str, ...]) -> DataFrame:
    """Kinds that occur and are in no list."""
    return rows.select(kind).distinct().filter(F.col(kind).isNull() | ~F.col(kind).isin(*known))


def must_be_empty(df: DataFrame, message: str) -> None:
    """Raise with the first rows if there are any."""
    first = df.limit(10).collect()
    if first:
        raise ValueError(f"{message}: {[tuple(r) for r in first]}")


def eligible_conversations(rows: DataFrame, conversation: str, condition: Column, least: int) -> DataFrame:
    """Conversations with at least `least` rows that meet the condition."""
    return rows.groupBy(conversation).agg(F.count_if(condition).alias("eligible")).filter(F.col("eligible") >= least)


def ordered_union(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of all parts in one global order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy(*keys)


def out_of_order(rows: DataFrame, conversation: str, at: str, order: list[str]) -> DataFrame:
    """Rows whose time is before that of the row before them in their conversation."""
    from talkmill.common import with_earlier

    laid = with_earlier(rows, conversation, order, 1)
    prev = F.lag(at).over(W.partitionBy(conversation, "_part").orderBy(*order))
    return laid.withColumn("_p", prev).filter(~F.col("_ghost") & (F.col(at) < F.col("_p"))).drop("_p", "_part", "_ghost")


def tenant_counts(rows: DataFrame, tenant: str) -> DataFrame:
    return rows.groupBy(tenant).agg(F.count("*").alias("n"))


def looks_conversational(table: str, columns: list[str]) -> bool:
    """By the table's name, or by having text, time and who columns."""
    has = lambda hints: any(h in c.lower() for c in columns for h in hints)
    return any(h in table.lower() for h in NAME_HINTS) or has(TEXT_HINTS) and has(TIME_HINTS) and has(WHO_HINTS)


def attach(items: DataFrame, assignment: DataFrame, key: str, value: str) -> DataFrame:
    """Left join of one value per item; an item without one raises when it is read."""
    held = items.join(assignment.select(key, value), key, "left")
    return held.withColumn(value, F.coalesce(value, F.raise_error(F.concat(F.lit(f"no {value} for item "), F.col(key).cast("string"))).cast("string")))


def time_of(df: DataFrame, column: str) -> Column:
    """A temporal column as it is; a text column cast, so that it is ordered by time and not by its letters."""
    temporal = dict(df.dtypes)[column].startswith(("timestamp", "date"))
    return F.col(column) if temporal else F.col(column).try_cast("timestamp_ntz")


def semi_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys of `a` are in `b`."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n"))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    both = a.select(key).distinct().withColumn("_x", F.lit(1)).join(b.select(key).distinct().withColumn("_y", F.lit(1)), key, "full_outer")
    return both.agg(F.count_if(F.col("_y").isNull()).alias("only_a"), F.count_if(F.col("_x").isNull()).alias("only_b"), F.count_if(F.col("_x").isNotNull() & F.col("_y").isNotNull()).alias("both"))


def turn_fields(turns: DataFrame, fields: DataFrame, key: str = "turn_id") -> DataFrame:
    """One annotation item for each turn and field; the field catalogue is small and checked for it."""
    from talkmill.common import lookup_rows

    n = len(lookup_rows(fields))
    return turns.crossJoin(F.broadcast(fields)).withColumn("item_id", F.concat_ws(":", F.col(key).cast("string"), "field_name")) if n else turns.limit(0).crossJoin(fields).withColumn("item_id", F.lit(None).cast("string"))

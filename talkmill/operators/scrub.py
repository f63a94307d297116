"""Scrubbing conversations by rules: spans, per-conversation placeholders, replaced texts, audit and residual scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.common import join_hot, spread, trimmed
from talkmill.functions.spans import found_spans, normal_value, redacted, resolved

SPAN_TOKENS = "array<struct<first:int,end:int,token:string>>"


def with_spans(rows: DataFrame, *, text: str = "text", roster: str | None = None) -> DataFrame:
    """`rows` with `spans` (resolved, in order)."""
    return spread(rows).withColumn("spans", resolved(found_spans(F.col(text), F.col(roster) if roster else None)))


def entries(rows: DataFrame, *, text: str = "text") -> DataFrame:
    """One row per replacement: conversation, turn, category, first, end, original, norm. `rows` have conversation, turn, text, spans."""
    each = rows.select("conversation", "turn", F.col(text).alias("_t"), F.explode(redacted(F.col("spans"))).alias("s"))
    value = F.substring(F.col("_t"), F.col("s.first") + 1, F.col("s.end") - F.col("s.first"))
    norm = normal_value(F.col("s.category"), F.coalesce("s.canonical", value))
    return each.select("conversation", "turn", F.col("s.category").alias("category"), F.col("s.first").alias("first"), F.col("s.end").alias("end"), value.alias("original"), norm.alias("norm"))


def rosters(rows: DataFrame) -> DataFrame:
    """(conversation, roster, rows): the speakers of each conversation by first appearance. `rows` have conversation, turn, speaker.

    Blank speakers are none. A roster is held whole, so it grows with the speakers of one conversation, not with its turns.
    """
    name = trimmed("speaker")
    each = rows.groupBy("conversation", F.when(name != "", name).alias("speaker")).agg(F.min("turn").alias("turn"), F.count("*").alias("n"))
    who = F.array_sort(F.collect_list(F.when(F.col("speaker").isNotNull(), F.struct("turn", "speaker"))))
    return each.groupBy("conversation").agg(F.transform(who, lambda x: x["speaker"]).alias("roster"), F.sum("n").alias("rows"))


def with_roster(rows: DataFrame, people: DataFrame) -> DataFrame:
    """`rows` with the `roster` of their conversation, of `rosters`."""
    return join_hot(rows, people, "conversation", "rows")


def placeholders(found: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """(conversation, category, norm, token): numbered by first appearance, where later places of a turn come first.

    The persons of `people` (of `rosters`) come first, in the order of the roster, whether or not they are found. The window is
    over the distinct values of one category in one conversation.
    """
    each = found.select("conversation", "category", "norm", F.struct(F.lit(1).alias("late"), "turn", (-F.col("first")).alias("p")).alias("o"))
    if people is not None:
        turn = found.schema["turn"].dataType
        named = people.select("conversation", F.posexplode("roster").alias("p", "speaker"))
        person = F.lit("PERSON")
        each = each.unionByName(named.select("conversation", person.alias("category"), normal_value(person, F.col("speaker")).alias("norm"), F.struct(F.lit(0).alias("late"), F.lit(None).cast(turn).alias("turn"), F.col("p")).alias("o")))
    first = each.groupBy("conversation", "category", "norm").agg(F.min("o").alias("o"))
    k = F.row_number().over(W.partitionBy("conversation", "category").orderBy("o"))
    return first.select("conversation", "category", "norm", F.concat(F.lit("["), "category", F.lit("_"), k.cast("string"), F.lit("]")).alias("token"))


def scrub(rows: DataFrame, *, text: str = "text", people: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns with `clean`, audit entries with `token`). `rows` have conversation, turn (unique within it) and text.

    With `people` (of `rosters`) the names of a conversation's speakers go as well, and turns keep their `roster`.
    """
    from talkmill.common import written
    from talkmill.functions.spans import replaced

    if people is not None:
        rows = with_roster(rows, people)
    held = written(with_spans(rows, text=text, roster="roster" if people is not None else None))
    found = entries(held, text=text)
    audit = written(found.join(placeholders(found, people), ["conversation", "category", "norm"]))
    tokens = audit.groupBy("conversation", "turn").agg(F.array_sort(F.collect_list(F.struct("first", "end", "token"))).alias("tokens"))
    out = held.join(tokens, ["conversation", "turn"], "left").withColumn("tokens", F.coalesce("tokens", F.array().cast(SPAN_TOKENS)))
    return out.withColumn("clean", replaced(F.col(text), F.col("tokens"))).drop("tokens", "spans"), audit


def replacement_counts(audit: DataFrame) -> DataFrame:
    """Per category: replacements, and distinct entities (a value counts once for each conversation)."""
    per = audit.groupBy("category", "conversation", "norm").agg(F.count("*").alias("n"))
    return per.groupBy("category").agg(F.sum("n").alias("replacements"), F.count("*").alias("entities"))


def residual(clean: DataFrame, *, text: str = "clean", roster: str | None = None) -> DataFrame:
    """Per category, what the rules still find after scrubbing; names only with the `roster` that scrubbing had."""
    from talkmill.common import written

    spans = resolved(found_spans(F.regexp_replace(F.col(text), r"\[[A-Z]+_\d+\]", " "), F.col(roster) if roster else None))
    held = written(clean.select(spans.alias("spans")))
    return held.select(F.explode(redacted(F.col("spans"))).alias("s")).groupBy(F.col("s.category").alias("category")).agg(F.count("*").alias("left"))


def speakers(rows: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """(conversation, speaker, speaker_id, role): SPEAKER_n by first appearance; role of the messages, else of the lookup, else unknown."""
    first = rows.filter("speaker is not null").groupBy("conversation", "speaker").agg(F.min("turn").alias("t"), F.min(F.nullif(F.trim("role"), F.lit(""))).alias("own"))
    k = F.row_number().over(W.partitionBy("conversation").orderBy("t", "speaker"))
    out = first.withColumn("speaker_id", F.concat(F.lit("SPEAKER_"), k.cast("string")))
    if roles is not None:
        look = roles.groupBy(F.col("speaker").alias("speaker")).agg(F.min("role").alias("_look"))
        out = out.join(look, "speaker", "left")
    else:
        out = out.withColumn("_look", F.lit(None).cast("string"))
    return out.select("conversation", "speaker", "speaker_id", F.coalesce("own", "_look", F.lit("unknown")).alias("role"))

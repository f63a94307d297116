"""Profiles of labelled items and of conversations: counts, distributions, duplicates, running context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.functions.text import (
    AMOUNT_PATTERN, CODE_MIXED_CUES, CORRECTION_CUES, FIELD_WORDS, HEDGE_CUES, LOCALITY_PATTERN, MEDIA_ORDER, STRATA, blank_to_null, cue_pattern, field_pattern, fields_mentioned, has_cue, media_kind, mentions, normalise_message, normalise_reply, rejection, script_flags, stable_hash, strata, word_count,
)

CLASS_FLOOR, MAX_CLASSES, MAX_SHARE, MAX_CHARS, MAX_WORDS = 10, 50, 0.5, 40, 6
CLASS_PATTERN = r"^[0-9A-Za-z][0-9A-Za-z _.\-/]*$"
CHARS_PER_TOKEN, LIMITS = 4.0, (32_000, 64_000)
CONTEXT, SPEAKERS = 6, 3


def items_of(df: DataFrame) -> DataFrame:
    """Labelled items: blank cells null, item_id from the row where missing."""
    clean = {c: blank_to_null(c) for c in ("conversation_id", "user_message", "action", "reply", "labeler", "split")}
    return df.select(F.col("row_no").alias("row"), F.coalesce(blank_to_null("item_id"), F.concat(F.lit("row-"), F.col("row_no").cast("string"))).alias("item_id"), F.col("turn_index"), *[e.alias(c) for c, e in clean.items()])


def percentile_block(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, median, nearest-rank p90, max and min of an integer column; zeros if empty.

    The p90 is the value at place round(0.9 n) (half to even), at least the first. It is found on the counts of the distinct
    values, so no list of values is gathered.
    """
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = W.partitionBy(*(by or [F.lit(1)])).orderBy("v")
    run = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(W.partitionBy(*(by or [F.lit(1)]))))
    place = lambda q: F.least(F.col("n"), F.greatest(F.lit(1), q))
    at = lambda q: F.min(F.when(F.col("upto") >= place(q), F.col("v")))
    half = F.col("n") / 2
    z = lambda c: F.coalesce(c, F.lit(0))
    return run.groupBy(*by).agg(
        z(F.max("n")).alias("n"), z(F.sum(F.col("v") * F.col("c")) / F.max("n")).cast("double").alias("mean"),
        z((at(F.ceil(half)) + at(F.floor(half) + 1)) / 2).cast("double").alias("median"), z(at(F.bround(F.col("n") * F.lit(0.9)).cast("bigint"))).alias("p90"), z(F.max("v")).alias("max"), z(F.min("v")).alias("min"),
    )


def shape(items: DataFrame) -> DataFrame:
    """One row: rows, conversations, distinct normalised messages, labelled and unlabelled, mean items of a conversation."""
    return items.agg(
        F.count("*").alias("items"), F.count_distinct("conversation_id").alias("conversations"), F.count_distinct(normalise_message(F.coalesce("user_message", F.lit("")))).alias("distinct_messages"),
        F.count_if(F.col("action").isNotNull() & F.col("reply").isNotNull()).alias("labelled"), F.count_if(F.col("action").isNull() | F.col("reply").isNull()).alias("unlabelled"),
        F.try_divide(F.count("conversation_id"), F.count_distinct("conversation_id")).alias("mean_cluster"),
    )


def items_per_conversation(items: DataFrame) -> DataFrame:
    return percentile_block(items.filter("conversation_id is not null").groupBy("conversation_id").agg(F.count("*").alias("k")), "k")


def class_safety(items: DataFrame) -> DataFrame:
    """Whether the class names may be shown: few, short and label-like."""
    a = F.col("action")
    return items.agg(
        F.count_distinct("action").alias("classes"), F.count("*").alias("n"),
        F.coalesce((F.count_distinct("action") <= MAX_CLASSES) & (F.try_divide(F.count_distinct("action"), F.count("*")) <= MAX_SHARE) & F.coalesce(F.bool_and((F.length(a) <= MAX_CHARS) & (word_count(a) <= MAX_WORDS) & a.rlike(CLASS_PATTERN)), F.lit(True)), F.lit(False)).alias("safe"),
    )


def action_distribution(items: DataFrame, show_names: bool = True) -> DataFrame:
    """Per class: count, whether below the floor, share; most frequent first. Withheld names are hashed."""
    counts = items.filter("action is not null").groupBy("action").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    out = counts.crossJoin(F.broadcast(total))  # a single row
    name = F.col("action") if show_names else stable_hash("action")
    return out.select(name.alias("class"), "n", (F.col("n") < CLASS_FLOOR).alias("below_floor"), (F.col("n") / F.col("_t")).alias("share")).orderBy(F.desc("n"), "class")


def reply_templating(items: DataFrame) -> DataFrame:
    """Distinct raw and normalised replies against their number (null ratios without replies)."""
    r = items.filter("reply is not null")
    return r.agg(
        F.count("*").alias("n"), F.count_distinct("reply").alias("raw"), F.count_distinct(normalise_reply("reply")).alias("templates"),
        F.try_divide(F.count_distinct("reply"), F.count("*")).alias("raw_ratio"), F.try_divide(F.count_distinct(normalise_reply("reply")), F.count("*")).alias("template_ratio"),
    )


def reply_lengths(items: DataFrame) -> DataFrame:
    """(unit, percentile block) of the characters and the words of replies."""
    r = items.filter("reply is not null").select(F.length("reply").cast("bigint").alias("chars"), word_count("reply").cast("bigint").alias("words"))
    block = lambda unit: percentile_block(r, unit).select(F.lit(unit).alias("unit"), "*")
    return block("chars").unionByName(block("words"))


def memory_dependence(items: DataFrame) -> DataFrame:
    """Messages that recur with different actions: groups, ambiguous groups and items, and conflicts at the same turn."""
    rows = items.filter("action is not null").select(normalise_message(F.coalesce("user_message", F.lit(""))).alias("m"), "turn_index", "action")
    by_turn = rows.groupBy("m", "turn_index").agg(F.count("*").alias("n"), F.count_distinct("action").alias("a"), F.min("action").alias("lo"), F.max("action").alias("hi"))
    by_msg = by_turn.groupBy("m").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count_if(F.col("a") >= 2).alias("same_turn"))
    many = (F.col("n") >= 2) & (F.col("lo") != F.col("hi"))
    return by_msg.agg(
        F.count_if(F.col("n") >= 2).alias("repeated_groups"), F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))), F.lit(0)).alias("repeated_items"), F.count_if(many).alias("ambiguous_groups"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("ambiguous_items"),
        F.count_if(many & (F.col("same_turn") > 0)).alias("same_turn_conflicts"), F.count_if(many & (F.col("same_turn") == 0)).alias("memory_groups"),
    )


def duplicate_groups(rows: DataFrame, text: str, split: str | None = None) -> DataFrame:
    """Groups of two or more rows with the same normalised text: hash, rows, and whether they cross splits."""
    key = normalise_message(F.coalesce(text, F.lit("")))
    s = F.col(split) if split else F.lit(None).cast("string")
    g = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.min(s).alias("lo"), F.max(s).alias("hi")).filter("n >= 2")
    return g.select(stable_hash("k").alias("group_hash"), "n", F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("crosses_splits"))


def duplicate_report(rows: DataFrame, text: str, split: str | None = None, show: int = 50) -> DataFrame:
    """Totals of `duplicate_groups` and the first hashes in order."""
    g = duplicate_groups(rows, text, split)
    totals = g.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_groups"), F.count_if("crosses_splits").alias("cross_split_groups"))
    first = g.select("group_hash").orderBy("group_hash").limit(show).agg(F.array_sort(F.collect_list("group_hash")).alias("first_hashes"))
    return totals.crossJoin(F.broadcast(first))  # single rows


def completeness(items: DataFrame) -> DataFrame:
    """Blank cells by column, and the share of rows with a labeler (0 without rows)."""
    cols = ["conversation_id", "user_message", "action", "reply", "labeler", "split"]
    blank = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("blank")) for c in cols]))
    counts = items.agg(*[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in cols], F.count("*").alias("n"), F.coalesce(F.try_divide(F.count("labeler"), F.count("*")), F.lit(0.0)).alias("labeler_coverage"))
    return counts.select(blank, "n", "labeler_coverage")


def turn_order() -> list[Column]:
    """The given turn where there is one, else the row."""
    return [F.coalesce(F.col("turn_index").cast("bigint"), F.col("row").cast("bigint")), F.col("row")]


def context_lengths(items: DataFrame) -> DataFrame:
    """Characters a prompt needs at each item: messages and replies before it in its conversation and its own message.

    Sums per conversation run over range-partitioned rows (see `common.running`), so a conversation may be of any size.
    """
    from talkmill.common import running

    size = F.length(F.coalesce("user_message", F.lit(""))) + F.length(F.coalesce("reply", F.lit("")))
    key, row = turn_order()
    rows = items.filter("conversation_id is not null").select("conversation_id", "row", key.alias("o1"), row.alias("o2"), F.length(F.coalesce("user_message", F.lit(""))).alias("own"), size.cast("bigint").alias("size"))
    held = running(rows, "conversation_id", ["o1", "o2"], F.col("size"), "before")
    return held.select("row", "conversation_id", (F.col("before") + F.col("own")).cast("bigint").alias("context_chars"))


def context_fit(lengths: DataFrame) -> DataFrame:
    """Percentiles of the estimated tokens of `context_lengths`, and how many fit each limit."""
    tokens = lengths.select(F.floor(F.col("context_chars") / CHARS_PER_TOKEN).cast("bigint").alias("t"))
    fits = tokens.agg(*[F.count_if(F.col("t") <= k).alias(f"fit_{k // 1000}k") for k in LIMITS])
    return percentile_block(tokens, "t").crossJoin(fits)  # single rows


# -- conversations ---------------------------------------------------------------------------------------------------
def turns_of(df: DataFrame) -> DataFrame:
    """Scrubbed turns: conversation, order, role (`unknown` where none), speaker, text."""
    return df.select(
        "turn_id", F.col("conversation_id").alias("conversation"), F.col("turn_index").cast("bigint").alias("turn_index"), F.coalesce(blank_to_null("speaker_role"), F.lit("unknown")).alias("role"),
        F.coalesce("speaker_id", F.lit("")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"), F.col("provenance.source").alias("source"), F.col("timestamp"),
    )


def _laid(turns: DataFrame, k: int) -> tuple[DataFrame, W]:
    """Turns laid out so that a conversation of any size is cut, and the window over their order."""
    from talkmill.common import with_earlier

    rows = with_earlier(turns.withColumn("_o", F.coalesce("turn_index", F.lit(2**31).cast("bigint"))), "conversation", ["_o", "turn_id"], k)
    return rows, W.partitionBy("conversation", "_part").orderBy("_o", "turn_id")


def in_context(turns: DataFrame, k: int = CONTEXT) -> DataFrame:
    """Each turn with its context: the k turns before it, and the distinct speakers of these and itself.

    A frame of fixed size: what is held for a row does not grow with its conversation.
    """
    rows, w = _laid(turns, k)
    seen = F.collect_list("speaker").over(w.rowsBetween(-k, 0))
    held = rows.withColumn("context", F.collect_list(F.struct("role", "text", "speaker")).over(w.rowsBetween(-k, -1))).withColumn("speakers", F.size(F.array_distinct(F.filter(seen, lambda s: s != ""))))
    return held.filter(~F.col("_ghost")).drop("_ghost", "_part", "_o")


def with_rejection(turns: DataFrame) -> DataFrame:
    return turns.withColumn("reason", rejection("role", "text"))


def census(turns: DataFrame, k: int = CONTEXT) -> DataFrame:
    """(section, name, n): totals, rejections, media kinds, strata, field mentions and code-mixed cues, zeros included."""
    rows, w = _laid(turns, k)
    rows = rows.withColumn("_s", F.size(F.array_distinct(F.filter(F.collect_list("speaker").over(w.rowsBetween(-k, 0)), lambda s: s != ""))))
    rows = with_rejection(rows.filter(~F.col("_ghost")))
    ok = F.col("reason").isNull()
    rows = rows.withColumn("_strata", F.when(ok, strata("text", F.col("_s"))))
    aggs = {("total", "turns"): F.count("*"), ("total", "eligible"): F.count_if(ok)}
    for r in ("not_customer", "media_placeholder", "empty", "too_short"):
        aggs["rejected", r] = F.count_if(F.col("reason") == r)
    for m in MEDIA_ORDER:
        aggs["media", m] = F.count_if((F.col("reason") == "media_placeholder") & (media_kind("text") == m))
    for s in STRATA:
        aggs["stratum", s] = F.count_if(F.array_contains("_strata", s))
    for f in sorted(FIELD_WORDS):
        aggs["field", f] = F.count_if(ok & mentions("text", f))
    aggs["code_mixed", "any"] = F.count_if(ok & has_cue("text", CODE_MIXED_CUES))
    return _long(rows, aggs)


def _long(rows: DataFrame, aggs: dict[tuple[str, str], Column]) -> DataFrame:
    """One aggregate pass, laid out as (section, name, n)."""
    names = list(aggs)
    one = rows.agg(*[a.cast("bigint").alias(f"a{k}") for k, a in enumerate(aggs.values())])
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.col(f"a{k}").alias("n")) for k, (s, n) in enumerate(names)])))


def cue_frequencies(turns: DataFrame) -> DataFrame:
    """(section, name, n): eligible turns holding each cue, zeros included, in one pass."""
    ok = with_rejection(turns).filter("reason is null")
    aggs = {("correction", c): F.count_if(F.col("text").rlike(cue_pattern((c,)))) for c in CORRECTION_CUES}
    aggs |= {("hedge", c): F.count_if(F.col("text").rlike(cue_pattern((c,)))) for c in HEDGE_CUES}
    return _long(ok.select("text"), aggs)


def field_word_frequencies(turns: DataFrame, reason: str | None = None) -> DataFrame:
    """(section, name, n): eligible turns (or those rejected for `reason`) holding each word of each field, bounded by letters as `mentions` has it, and the two other patterns; zeros included."""
    ok = with_rejection(turns).filter(F.col("reason").eqNullSafe(F.lit(reason)))
    aggs = {(f, w): F.count_if(F.col("text").rlike(field_pattern((w,)))) for f in sorted(FIELD_WORDS) for w in FIELD_WORDS[f]}
    aggs |= {("pattern", "amount"): F.count_if(F.col("text").rlike(AMOUNT_PATTERN)), ("pattern", "locality_suffix"): F.count_if(F.col("text").rlike(LOCALITY_PATTERN))}
    return _long(ok.select("text"), aggs)


def script_profile(turns: DataFrame) -> DataFrame:
    """(section, name, n): eligible turns by script bucket."""
    ok = with_rejection(turns).filter("reason is null").select("text")
    flags = script_flags("text")
    return _long(ok, {("all", "turns"): F.count("*"), **{("script", k): F.count_if(f) for k, f in flags.items()}, ("script", "symbols_only"): F.count_if(flags["other_non_ascii"] & ~flags["non_ascii_letter"])})


def script_shares(turns: DataFrame) -> DataFrame:
    """(population, bucket, n, share): turns by script among all eligible ones and those that mention a field; null shares without turns."""
    ok = with_rejection(turns).filter("reason is null").select("text", F.size(fields_mentioned("text")).alias("_f"))
    each = ok.withColumn("population", F.explode(F.array_compact(F.array(F.lit("eligible"), F.when(F.col("_f") > 0, F.lit("field_mentioning"))))))
    flags = script_flags("text")
    counts = each.groupBy("population").agg(F.count("*").alias("n_all"), *[F.count_if(f).alias(k) for k, f in flags.items()])
    both = ok.sparkSession.createDataFrame([("eligible",), ("field_mentioning",)], "population string").join(counts, "population", "left")
    held = F.inline(F.array(*[F.struct(F.lit(k).alias("bucket"), F.coalesce(F.col(k), F.lit(0)).alias("n")) for k in flags]))
    return both.select("population", "n_all", held).select("population", "bucket", "n", F.round(F.try_divide("n", "n_all"), 4).alias("share"))


def cue_diagnostics(turns: DataFrame) -> DataFrame:
    """(section, name, n) over eligible turns: how many there are, how many cue forms of each kind matched any, and whether none did."""
    ok = with_rejection(turns).filter("reason is null").select("text")
    kinds = {"correction": CORRECTION_CUES, "hedge": HEDGE_CUES, "code_mixed": CODE_MIXED_CUES}
    one = ok.agg(F.count("*").alias("n"), *[F.coalesce(F.max(F.col("text").rlike(cue_pattern((c,))).cast("bigint")), F.lit(0)).alias(f"{k}{j}") for k, cues in kinds.items() for j, c in enumerate(cues)])
    met = {k: sum((F.col(f"{k}{j}") for j in range(len(cues))), F.lit(0).cast("bigint")) for k, cues in kinds.items()}
    none = ((met["correction"] + met["hedge"]) == 0).cast("bigint")
    rows = [("turns", "eligible", F.col("n")), *[("forms", k, m) for k, m in met.items()], ("cue", "no_cue_matched", none)]
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), c.cast("bigint").alias("n")) for s, n, c in rows])))


def short_turns(turns: DataFrame) -> DataFrame:
    """(section, name, n): turns rejected as too short, by cue, number of words and script."""
    short = with_rejection(turns).filter("reason = 'too_short'").select("text")
    flags = script_flags("text")
    return _long(short, {("all", "turns"): F.count("*"), ("cue", "correction"): F.count_if(has_cue("text", CORRECTION_CUES)), ("cue", "hedge"): F.count_if(has_cue("text", HEDGE_CUES)), ("words", "one"): F.count_if(word_count("text") == 1), ("words", "two"): F.count_if(word_count("text") == 2), ("script", "ascii_only"): F.count_if(flags["ascii_only"])})


def conversation_counts(turns: DataFrame) -> DataFrame:
    """Per conversation: rows, eligible customer turns, a map of roles to counts."""
    per = with_rejection(turns).groupBy("conversation", "role").agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("ok"))
    return per.groupBy("conversation").agg(F.sum("n").alias("turns"), F.sum("ok").alias("eligible"), F.array_join(F.array_sort(F.collect_list(F.concat("role", F.lit("="), F.col("n").cast("string")))), ",").alias("roles"))


def conversation_times(turns: DataFrame) -> DataFrame:
    """Per conversation: first and last written time, and its media kinds with their counts."""
    from talkmill.functions.dates import parsed

    at = parsed(F.col("timestamp"))
    per = turns.groupBy("conversation", media_kind("text").alias("kind")).agg(F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    kinds = F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.concat("kind", F.lit("="), F.col("n").cast("string"))))), ",")
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return per.groupBy("conversation").agg(show(F.min("lo")).alias("first"), show(F.max("hi")).alias("last"), kinds.alias("kinds"))


def inversions(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Per group: how often a value is above the one before it, and whether the values fall strictly."""
    from talkmill.common import with_earlier

    laid = with_earlier(rows.withColumn("_g", F.struct(*by)), "_g", order, 1)
    prev = F.lag(value).over(W.partitionBy("_g", "_part").orderBy(*order))
    held = laid.withColumn("_p", prev).filter(~F.col("_ghost"))
    return held.groupBy(*by).agg(F.count_if(F.col(value) > F.col("_p")).alias("inversions"), F.coalesce(F.bool_and(F.when(F.col("_p").isNotNull(), F.col(value) < F.col("_p"))), F.lit(True)).alias("strictly_decreasing"))

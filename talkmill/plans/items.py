"""Profiles of labelled items."""

from pyspark.sql import functions as F

from talkmill.common import table
from talkmill.operators import gates
from talkmill.operators import profile as P
from talkmill.plans.fragments import ITEMS, block, message, reply

_I = lambda s, d: P.items_of(table(s, d, "items"))


def ag9_context(spark, sf_dir):
    return P.context_lengths(_I(spark, sf_dir))


def gt4_gate(spark, sf_dir):
    """Class floor, items that depend on more than their message, duplicates across splits or with the pilot's conversations, labeler coverage."""
    items = _I(spark, sf_dir)
    classes = P.action_distribution(items).agg(F.count_if("below_floor").alias("below"), F.count("*").alias("classes"))
    row = classes.crossJoin(P.memory_dependence(items)).crossJoin(P.duplicate_report(items, "user_message", "split").select("cross_split_groups"))
    pilot = table(spark, sf_dir, "syn_020").select(F.col("conversation_id").alias("_c")).filter("_c is not null").distinct()
    row = row.crossJoin(items.agg(F.count("labeler").alias("labelled_by"), F.count("*").alias("n"))).crossJoin(items.join(pilot, F.col("conversation_id") == F.col("_c"), "left_semi").agg(F.count("*").alias("overlap")))  # single rows
    enough = F.col("ambiguous_items") >= 30  # a shortfall of this lower bound says nothing
    parts = {
        "class_floor": (F.lit(True), F.col("below") == 0), "memory": (enough, enough),
        "duplicates": (F.lit(True), (F.col("cross_split_groups") == 0) & (F.col("overlap") == 0)), "coverage": (F.lit(True), (F.col("n") > 0) & (F.round(F.col("labelled_by") / F.col("n"), 4) >= 1.0)),
    }
    rows = gates.conditions(row, parts)
    return rows.unionByName(gates.overall(rows).select(F.lit("gate").alias("condition"), "verdict"))


def ag7_groups(spark, sf_dir):
    return P.duplicate_groups(_I(spark, sf_dir), "user_message", "split")


def ag2_lengths(spark, sf_dir):
    rows = _I(spark, sf_dir).withColumn("k", F.length("user_message").cast("bigint"))
    return P.percentile_block(rows.filter("labeler is not null"), "k", ["labeler"])


QUERIES = {
    "ag1_shape": lambda s, d: P.shape(_I(s, d)),
    "ag2_items_per_conversation": lambda s, d: P.items_per_conversation(_I(s, d)),
    "ag2_lengths": ag2_lengths,
    "ag3_actions": lambda s, d: P.action_distribution(_I(s, d)),
    "ag3_actions_hashed": lambda s, d: P.action_distribution(_I(s, d), show_names=False),
    "ag4_class_safety": lambda s, d: P.class_safety(_I(s, d)),
    "ag5_templates": lambda s, d: P.reply_templating(_I(s, d)),
    "ag5_lengths": lambda s, d: P.reply_lengths(_I(s, d)),
    "ag6_memory": lambda s, d: P.memory_dependence(_I(s, d)),
    "ag7_duplicates": lambda s, d: P.duplicate_report(_I(s, d), "user_message", "split").withColumn("first_hashes", F.array_join("first_hashes", ",")),
    "ag7_groups": ag7_groups,
    "ag8_completeness": lambda s, d: P.completeness(_I(s, d)),
    "ag9_context": ag9_context,
    "ag9_fit": lambda s, d: P.context_fit(ag9_context(s, d)),
    "gt4_gate": gt4_gate,
}

_M, _R = message("coalesce(user_message, '')"), reply("reply")
_GROUPS = f"g AS (SELECT {_M} AS k, count(*) AS n, min(split) AS lo, max(split) AS hi FROM i GROUP BY 1 HAVING count(*) >= 2)"
_CONTEXT = "c AS (SELECT row, conversation_id, (coalesce(sum(length(coalesce(user_message, '')) + length(coalesce(reply, ''))) OVER (PARTITION BY conversation_id ORDER BY coalesce(turn_index, row), row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(coalesce(user_message, '')))::BIGINT AS context_chars FROM i WHERE conversation_id IS NOT NULL)"
_MEMORY = f"""bt AS (SELECT {_M} AS m, turn_index, count(*) AS n, count(DISTINCT action) AS a, min(action) AS lo, max(action) AS hi FROM i WHERE action IS NOT NULL GROUP BY 1, 2),
bm AS (SELECT m, sum(n) AS n, min(lo) AS lo, max(hi) AS hi, count_if(a >= 2) AS st FROM bt GROUP BY 1),
mem AS (SELECT count_if(n >= 2)::BIGINT AS repeated_groups, coalesce(sum(CASE WHEN n >= 2 THEN n END), 0)::BIGINT AS repeated_items, count_if(n >= 2 AND lo <> hi)::BIGINT AS ambiguous_groups, coalesce(sum(CASE WHEN n >= 2 AND lo <> hi THEN n END), 0)::BIGINT AS ambiguous_items,
  count_if(n >= 2 AND lo <> hi AND st > 0)::BIGINT AS same_turn_conflicts, count_if(n >= 2 AND lo <> hi AND st = 0)::BIGINT AS memory_groups FROM bm)"""
_SAFE = "(count(DISTINCT action) <= 50 AND count(DISTINCT action) / count(*) <= 0.5 AND coalesce(bool_and(length(action) <= 40 AND len(regexp_extract_all(action, '[^\\s\\pZ]+')) <= 6 AND regexp_matches(action, '^[0-9A-Za-z][0-9A-Za-z _.\\-/]*$')), true))"


def _actions(name: str) -> str:
    return f"WITH {ITEMS}, a AS (SELECT action, count(*) AS n FROM i WHERE action IS NOT NULL GROUP BY 1) SELECT {name} AS class, n, n < 10 AS below_floor, n / (SELECT sum(n) FROM a) AS share FROM a"


ORACLES = {
    "ag1_shape": f"WITH {ITEMS} SELECT count(*) AS items, count(DISTINCT conversation_id) AS conversations, count(DISTINCT {_M}) AS distinct_messages, count_if(action IS NOT NULL AND reply IS NOT NULL)::BIGINT AS labelled, count_if(action IS NULL OR reply IS NULL)::BIGINT AS unlabelled, count(conversation_id) / nullif(count(DISTINCT conversation_id), 0) AS mean_cluster FROM i",
    "ag2_items_per_conversation": f"WITH {ITEMS}, k AS (SELECT count(*) AS k FROM i WHERE conversation_id IS NOT NULL GROUP BY conversation_id) {block('k', 'k')}",
    "ag2_lengths": f"WITH {ITEMS} SELECT labeler, count(k) AS n, avg(k)::DOUBLE AS mean, median(k)::DOUBLE AS median, list_sort(list(k))[greatest(1, least(count(k), round_even(0.9 * count(k), 0)::BIGINT))] AS p90, max(k) AS max, min(k) AS min FROM (SELECT labeler, length(user_message) AS k FROM i WHERE labeler IS NOT NULL AND user_message IS NOT NULL) GROUP BY labeler",
    "ag3_actions": _actions("action"),
    "ag3_actions_hashed": _actions("substr(sha256(action), 1, 12)"),
    "ag4_class_safety": f"WITH {ITEMS} SELECT count(DISTINCT action) AS classes, count(*) AS n, {_SAFE} AS safe FROM i",
    "ag5_templates": f"WITH {ITEMS} SELECT count(*) AS n, count(DISTINCT reply) AS raw, count(DISTINCT {_R}) AS templates, count(DISTINCT reply) / nullif(count(*), 0) AS raw_ratio, count(DISTINCT {_R}) / nullif(count(*), 0) AS template_ratio FROM i WHERE reply IS NOT NULL",
    "ag6_memory": f"WITH {ITEMS}, {_MEMORY} SELECT * FROM mem",
    "ag7_duplicates": f"WITH {ITEMS}, {_GROUPS} SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows_in_groups, count_if(lo <> hi)::BIGINT AS cross_split_groups, (SELECT array_to_string(list(h ORDER BY h), ',') FROM (SELECT substr(sha256(k), 1, 12) AS h FROM g ORDER BY h LIMIT 50)) AS first_hashes FROM g",
    "ag7_groups": f"WITH {ITEMS}, {_GROUPS} SELECT substr(sha256(k), 1, 12) AS group_hash, n, coalesce(lo <> hi, false) AS crosses_splits FROM g",
    "ag8_completeness": f"WITH {ITEMS}, n AS (SELECT count(*) AS n, coalesce(count(labeler) / nullif(count(*), 0), 0.0) AS labeler_coverage FROM i) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", (SELECT count_if({c} IS NULL) FROM i)::BIGINT AS blank, n, labeler_coverage FROM n" for c in ("conversation_id", "user_message", "action", "reply", "labeler", "split")),
    "ag9_context": f"WITH {ITEMS}, {_CONTEXT} SELECT * FROM c",
    "ag9_fit": f"WITH {ITEMS}, {_CONTEXT}, k AS (SELECT floor(context_chars / 4.0)::BIGINT AS k FROM c), b AS ({block('k', 'k')}) SELECT *, (SELECT count_if(k <= 32000) FROM k)::BIGINT AS fit_32k, (SELECT count_if(k <= 64000) FROM k)::BIGINT AS fit_64k FROM b",
    "gt4_gate": f"""WITH {ITEMS}, {_MEMORY}, {_GROUPS}, a AS (SELECT count(*) AS n FROM i WHERE action IS NOT NULL GROUP BY action),
      v AS (SELECT 'class_floor' AS condition, CASE WHEN (SELECT count_if(n < 10) FROM a) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict
      UNION ALL SELECT 'memory', CASE WHEN (SELECT ambiguous_items FROM mem) >= 30 THEN 'PASS' ELSE 'NOT_ESTABLISHED' END
      UNION ALL SELECT 'duplicates', CASE WHEN (SELECT count_if(lo <> hi) FROM g) = 0 AND (SELECT count(*) FROM i WHERE conversation_id IN (SELECT conversation_id FROM syn_020)) = 0 THEN 'PASS' ELSE 'FAIL' END
      UNION ALL SELECT 'coverage', CASE WHEN count(*) > 0 AND round(count(labeler) / count(*), 4) >= 1 THEN 'PASS' ELSE 'FAIL' END FROM i)
      SELECT * FROM v UNION ALL SELECT 'gate', CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(verdict = 'NOT_ESTABLISHED') THEN 'NOT_ESTABLISHED' ELSE 'PASS' END FROM v""",
}

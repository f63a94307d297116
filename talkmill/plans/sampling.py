"""Deterministic samples, orders and splits."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from talkmill.common import table
from talkmill.functions import text as X
from talkmill.functions.dates import FORMATS, parsed
from talkmill.operators import extract as E
from talkmill.operators import profile as P
from talkmill.operators import sampling as A
from talkmill.operators.stats import LABELS
from talkmill.plans.fragments import ITEMS, REASON, TURNS, any_field, cue, sha

_items = lambda s, d: P.items_of(table(s, d, "items"))
_turns = lambda s, d: P.turns_of(table(s, d, "syn_020"))
SINCE, UNTIL = datetime(2025, 6, 1), datetime(2026, 3, 1)


def _candidates(spark, sf_dir):
    t = _turns(spark, sf_dir).filter(X.rejection("role", "text").isNull())
    return t.select("turn_id", X.strata("text", F.lit(0)).alias("strata"))


def sm1_conversations(spark, sf_dir):
    """40 conversations with at least four eligible customer turns."""
    pool = E.eligible_conversations(_turns(spark, sf_dir), "conversation", X.rejection("role", "text").isNull(), 4)
    return A.sample(pool, 40, "sm1", "conversation").orderBy("conversation")


def sm2_quotas(spark, sf_dir):
    return A.quota_sample(_candidates(spark, sf_dir), 300, "sm2")


def sm3_recheck(spark, sf_dir):
    return A.sample(_items(spark, sf_dir).filter("action is not null"), 30, "sm3", "row").select("row", "item_id")


def sm5_orders(spark, sf_dir):
    blocks = _items(spark, sf_dir).select(F.col("row").alias("key"))
    return A.annotator_orders(blocks, ["a", "b", "c"], "sm5")


def wn11_split(spark, sf_dir):
    return A.split_by_conversation(_items(spark, sf_dir), {"test": 200, "dev": 100}, "wn11")


def sm9_whole_turns(spark, sf_dir):
    rows = E.turn_fields(_turns(spark, sf_dir).select("turn_id"), table(spark, sf_dir, "field_catalog"))
    return A.whole_turns(rows, 1003, 5).select("turn_id", "item_id", "field_name", "field_type")


def jn18_fields(spark, sf_dir):
    return E.turn_fields(_turns(spark, sf_dir).select("turn_id"), table(spark, sf_dir, "field_catalog")).groupBy("field_name").agg(F.count("*").alias("n"), F.min("item_id").alias("first"))


def flt1_range(spark, sf_dir):
    m = table(spark, sf_dir, "messages")
    return m.filter(E.in_range(F.col("ingested_at"), SINCE, UNTIL)).groupBy("source_file").agg(F.count("*").alias("n"), F.count_if(E.kept(F.coalesce("role", F.lit("none")), F.col("text"), ("customer", "agent", "system"), ("customer", "agent"))).alias("kept"))


def flt3_projection(spark, sf_dir):
    m = table(spark, sf_dir, "messages")
    return m.select("message_id", E.projected(F.col("role"), F.col("text"), ("customer", "agent"), {"bot": "[automatic]", "system": "[note]"}).alias("body"))


def so_sets(spark, sf_dir):
    i, a = table(spark, sf_dir, "syn_020").select("conversation_id"), table(spark, sf_dir, "annotations").select("conversation_id")
    return E.symmetric_difference(i, a, "conversation_id")


def wn8_order(spark, sf_dir):
    """Messages ingested before the message above them in their file."""
    m = table(spark, sf_dir, "messages").select("message_id", "source_file", "source_row", "ingested_at")
    return E.out_of_order(m, "source_file", "ingested_at", ["source_row"]).select("message_id", "source_file", "source_row")


def dt1_parsed(spark, sf_dir):
    m = table(spark, sf_dir, "messages")
    return m.select("message_id", F.date_format(parsed(F.col("timestamp_raw")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def ma6_hash(spark, sf_dir):
    """A fingerprint of each source file's texts, in row order, and of the corpus in file order."""
    m = table(spark, sf_dir, "messages").filter("source_file is not null")
    rows = m.groupBy("source_file").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("source_row").cast("string"), F.coalesce("text", F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")).alias("sum"))
    return rows.select("source_file", "n", F.sha2(F.concat_ws(":", "source_file", F.col("n").cast("string"), F.col("sum").cast("string")), 256).alias("hash"))


def flt14_labels(spark, sf_dir):
    """Labels outside the vocabulary."""
    return table(spark, sf_dir, "annotations").filter(~F.coalesce(F.trim("label"), F.lit("")).isin(*LABELS)).groupBy("label").agg(F.count("*").alias("n"))


def jn7_sources(spark, sf_dir):
    """Annotations with the source of their conversation (a completeness check raises where there is none)."""
    src = table(spark, sf_dir, "syn_020").groupBy("conversation_id").agg(F.min("provenance.source").alias("source"))
    a = table(spark, sf_dir, "annotations").join(src.select("conversation_id"), "conversation_id", "left_semi")
    return E.attach(a, src, "conversation_id", "source").groupBy("source").agg(F.count("*").alias("n"))


QUERIES = {
    "dt1_parsed": dt1_parsed, "ma6_hash": ma6_hash, "flt14_labels": flt14_labels, "jn7_sources": jn7_sources,
    "sm1_conversations": sm1_conversations, "sm2_quotas": sm2_quotas, "sm2_shortfall": lambda s, d: A.shortfall(sm2_quotas(s, d), 300), "sm3_recheck": sm3_recheck,
    "sm4_few_shot": lambda s, d: A.few_shot(_items(s, d), 8, "sm4"), "sm5_orders": sm5_orders, "sm6_aliases": lambda s, d: A.aliases(_items(s, d), "conversation_id", "sm6"), "sm7_batches": lambda s, d: A.batches(_items(s, d), "row", "sm7"),
    "sm9_whole_turns": sm9_whole_turns, "wn5_names": lambda s, d: A.numbered_conversations(_items(s, d), "conversation_id"), "wn8_order": wn8_order, "wn11_split": wn11_split, "jn8_overlap": lambda s, d: E.semi_count(table(s, d, "annotations"), table(s, d, "syn_020"), "conversation_id"),
    "jn18_fields": jn18_fields, "flt1_range": flt1_range, "flt3_projection": flt3_projection, "flt10_unclassified": lambda s, d: E.unclassified(table(s, d, "messages"), "role", ("customer", "agent", "system", "bot")), "so2_sets": so_sets,
    "ag14_tenants": lambda s, d: E.tenant_counts(table(s, d, "documents"), "builder_id"),
}

_STRATA = {"correction": cue("text", X.CORRECTION_CUES), "field_mention": any_field("text"), "hedge": cue("text", X.HEDGE_CUES)}
_Q = f"""c AS (SELECT turn_id, {', '.join(f'{e} AS {k}' for k, e in _STRATA.items())} FROM (SELECT *, {REASON} AS reason FROM t) WHERE reason IS NULL),
s1 AS (SELECT turn_id FROM c WHERE correction ORDER BY {sha("'sm2:correction'", 'turn_id::VARCHAR')}, turn_id LIMIT 60),
s2 AS (SELECT turn_id FROM c WHERE field_mention AND turn_id NOT IN (SELECT turn_id FROM s1) ORDER BY {sha("'sm2:field_mention'", 'turn_id::VARCHAR')}, turn_id LIMIT 120),
s3 AS (SELECT turn_id FROM c WHERE hedge AND turn_id NOT IN (SELECT turn_id FROM s1 UNION ALL SELECT turn_id FROM s2) ORDER BY {sha("'sm2:hedge'", 'turn_id::VARCHAR')}, turn_id LIMIT 60),
s4 AS (SELECT turn_id FROM c WHERE turn_id NOT IN (SELECT turn_id FROM s1 UNION ALL SELECT turn_id FROM s2 UNION ALL SELECT turn_id FROM s3) ORDER BY {sha("'sm2:random'", 'turn_id::VARCHAR')}, turn_id LIMIT 60),
q AS (SELECT turn_id, 'correction' AS stratum FROM s1 UNION ALL SELECT turn_id, 'field_mention' FROM s2 UNION ALL SELECT turn_id, 'hedge' FROM s3 UNION ALL SELECT turn_id, 'random' FROM s4)"""
_CONV = f"cv AS (SELECT conversation_id, count(*) AS items, {sha(chr(39) + 'wn11' + chr(39), 'conversation_id')} AS h FROM i WHERE conversation_id IS NOT NULL GROUP BY 1), c1 AS (SELECT *, coalesce(sum(items) OVER (ORDER BY h, conversation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM cv), c2 AS (SELECT conversation_id, items, coalesce(sum(items) OVER (ORDER BY h, conversation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c1 WHERE b >= 200)"
_FIRST = f"f AS (SELECT action, min((h, row)) AS x FROM (SELECT action, row, {sha(chr(39) + 'sm4' + chr(39), 'row::VARCHAR')} AS h FROM i WHERE action IS NOT NULL) GROUP BY 1 ORDER BY action LIMIT 8), o AS (SELECT x[2] AS row, action FROM f UNION ALL (SELECT row, action FROM i WHERE action IS NOT NULL AND row NOT IN (SELECT x[2] FROM f) ORDER BY {sha(chr(39) + 'sm4' + chr(39), 'row::VARCHAR')} LIMIT greatest(0, 8 - (SELECT count(*) FROM f))))"

_FMT = [f.replace("yyyy", "%Y").replace("yy", "%y").replace("d", "%-d").replace("M", "%-m").replace("H", "%-H").replace("h", "%-I").replace(":m", ":%-M").replace(":s", ":%-S").replace("a", "%p") for f in FORMATS]
_SHAPE = [r"\d{1,2}".join(re.split("N", f.replace("yyyy", "Y").replace("yy", "y").replace("a", "P").replace("d", "N").replace("M", "N").replace("H", "N").replace("h", "N").replace("m", "N").replace("s", "N"))).replace("Y", r"\d{4}").replace("y", r"\d{2}").replace("P", "[AaPp][Mm]") for f in FORMATS]
_ISO = r"(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"

ORACLES = {
    "dt1_parsed": f"SELECT message_id, strftime(coalesce(CASE WHEN regexp_full_match(x, '{_ISO}') THEN try_strptime(regexp_extract(x, '{_ISO}', 1) || ' ' || regexp_extract(x, '{_ISO}', 2), '%Y-%m-%d %H:%M:%S') END, " + ", ".join(f"CASE WHEN regexp_full_match(x, '{s}') THEN try_strptime(x, '{f}') END" for f, s in zip(_FMT, _SHAPE)) + "), '%Y-%m-%d %H:%M:%S') AS parsed FROM (SELECT message_id, trim(timestamp_raw) AS x FROM messages)",
    "ma6_hash": "SELECT source_file, n, sha256(concat_ws(':', source_file, n::VARCHAR, s::VARCHAR)) AS hash FROM (SELECT source_file, count(*) AS n, sum(('0x' || substr(sha256(concat_ws(':', source_row::VARCHAR, coalesce(text, ''))), 1, 8))::BIGINT) AS s FROM messages WHERE source_file IS NOT NULL GROUP BY 1)",
    "flt14_labels": "SELECT label, count(*) AS n FROM annotations WHERE coalesce(trim(label), '') NOT IN (" + ", ".join(f"'{x}'" for x in LABELS) + ") GROUP BY 1",
    "jn7_sources": "SELECT source, count(*) AS n FROM annotations JOIN (SELECT conversation_id, min(provenance.source) AS source FROM syn_020 GROUP BY 1) USING (conversation_id) GROUP BY 1",
    "sm1_conversations": f"WITH {TURNS}, p AS (SELECT conversation, count_if({REASON} IS NULL)::BIGINT AS eligible FROM t GROUP BY 1 HAVING count_if({REASON} IS NULL) >= 4) SELECT * FROM p ORDER BY {sha(chr(39) + 'sm1' + chr(39), 'conversation')}, conversation LIMIT 40",
    "sm2_quotas": f"WITH {TURNS}, {_Q} SELECT * FROM q",
    "sm2_shortfall": f"WITH {TURNS}, {_Q}, g(stratum, target) AS (VALUES ('correction', 60), ('field_mention', 120), ('hedge', 60), ('random', 60)) SELECT stratum, target, (SELECT count(*) FROM q WHERE q.stratum = g.stratum) AS got, greatest(0, target - (SELECT count(*) FROM q WHERE q.stratum = g.stratum))::BIGINT AS missing FROM g",
    "sm3_recheck": f"WITH {ITEMS} SELECT row, item_id FROM i WHERE action IS NOT NULL ORDER BY {sha(chr(39) + 'sm3' + chr(39), 'row::VARCHAR')}, row LIMIT 30",
    "sm4_few_shot": f"WITH {ITEMS}, {_FIRST} SELECT row, action, row_number() OVER (ORDER BY {sha(chr(39) + 'order:sm4' + chr(39), 'row::VARCHAR')}, row)::INT AS place FROM o",
    "sm5_orders": f"WITH a(annotator) AS (VALUES ('a'), ('b'), ('c')) SELECT annotator, row_no AS key, row_number() OVER (PARTITION BY annotator ORDER BY {sha(chr(39) + 'sm5' + chr(39), 'annotator', chr(39) + '0' + chr(39), 'row_no::VARCHAR')}, row_no) - 1 AS place FROM items, a",
    "sm6_aliases": f"WITH {ITEMS}, d AS (SELECT DISTINCT conversation_id FROM i WHERE conversation_id IS NOT NULL) SELECT conversation_id, 'c' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS alias FROM (SELECT conversation_id, row_number() OVER (ORDER BY {sha(chr(39) + 'alias:sm6' + chr(39), 'conversation_id')}, conversation_id) AS k FROM d)",
    "sm7_batches": f"WITH k AS (SELECT row_no AS row, row_number() OVER (ORDER BY {sha(chr(39) + 'sm7' + chr(39), 'row_no::VARCHAR')}, row_no) - 1 AS k FROM items) SELECT row, k // 8 AS batch, k % 8 AS place FROM k",
    "sm9_whole_turns": "WITH t AS (SELECT DISTINCT turn_id FROM syn_020 ORDER BY turn_id LIMIT 200) SELECT turn_id, turn_id || ':' || field_name AS item_id, field_name, field_type FROM t, field_catalog",
    "wn5_names": f"WITH {ITEMS}, d AS (SELECT DISTINCT conversation_id FROM i WHERE conversation_id IS NOT NULL) SELECT conversation_id, 'conv_' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS name FROM (SELECT conversation_id, row_number() OVER (ORDER BY conversation_id) AS k FROM d)",
    "wn8_order": "SELECT message_id, source_file, source_row FROM (SELECT *, lag(ingested_at) OVER (PARTITION BY source_file ORDER BY source_row) AS p FROM messages) WHERE ingested_at < p",
    "wn11_split": f"WITH {ITEMS}, {_CONV} SELECT conversation_id, items, 'test' AS split FROM c1 WHERE b < 200 UNION ALL SELECT conversation_id, items, CASE WHEN b < 100 THEN 'dev' ELSE 'train' END FROM c2",
    "jn8_overlap": "SELECT count(*) AS n FROM (SELECT DISTINCT conversation_id FROM annotations WHERE conversation_id IN (SELECT conversation_id FROM syn_020))",
    "jn18_fields": "SELECT field_name, count(*) AS n, min(turn_id || ':' || field_name) AS first FROM syn_020, field_catalog GROUP BY 1",
    "flt1_range": "SELECT source_file, count(*) AS n, count_if(role IN ('customer', 'agent', 'system') AND (role = 'system' OR trim(coalesce(text, '')) <> ''))::BIGINT AS kept FROM messages WHERE ingested_at >= '2025-06-01' AND ingested_at < '2026-03-01' GROUP BY 1",
    "flt3_projection": "SELECT message_id, CASE WHEN role IN ('customer', 'agent') THEN text WHEN role = 'bot' THEN '[automatic]' WHEN role = 'system' THEN '[note]' END AS body FROM messages",
    "flt10_unclassified": "SELECT DISTINCT role FROM messages WHERE role IS NULL OR role NOT IN ('customer', 'agent', 'system', 'bot')",
    "so2_sets": "WITH a AS (SELECT DISTINCT conversation_id FROM syn_020), b AS (SELECT DISTINCT conversation_id FROM annotations) SELECT (SELECT count(*) FROM a WHERE conversation_id NOT IN (SELECT conversation_id FROM b)) AS only_a, (SELECT count(*) FROM b WHERE conversation_id NOT IN (SELECT conversation_id FROM a)) AS only_b, (SELECT count(*) FROM a WHERE conversation_id IN (SELECT conversation_id FROM b)) AS both",
    "ag14_tenants": "SELECT builder_id, count(*) AS n FROM documents GROUP BY 1",
}

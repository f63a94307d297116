"""Census of scrubbed turns, and the text functions by turn."""

from pyspark.sql import functions as F

from talkmill.common import table
from talkmill.functions import text as X
from talkmill.operators import profile as P
from talkmill.plans.fragments import MEDIA, MEDIA_KIND, REASON, TURNS, any_field, cue, field, long, message, words

_T = lambda s, d: P.turns_of(table(s, d, "syn_020"))


def fn12_fields(spark, sf_dir):
    return _T(spark, sf_dir).select("turn_id", F.array_join(X.fields_mentioned("text"), ",").alias("fields"))


def fn13_strata(spark, sf_dir):
    rows = P.in_context(_T(spark, sf_dir)).filter(X.rejection("role", "text").isNull())
    return rows.select("turn_id", F.array_join(X.strata("text", F.col("speakers")), ",").alias("strata"))


def wn3_context(spark, sf_dir):
    rows = P.in_context(_T(spark, sf_dir))
    return rows.select("turn_id", F.size("context").alias("n_context"), "speakers", F.sha2(X.context_lines(F.col("context")), 256).alias("context_hash"))


def fn4_messages(spark, sf_dir):
    return _T(spark, sf_dir).select("turn_id", X.stable_hash(X.normalise_message("text")).alias("message_hash"), X.word_count("text").cast("bigint").alias("words"), X.stable_hash(X.normalise_reply("text")).alias("template_hash"))


def fn14_scripts(spark, sf_dir):
    f = X.script_flags("text")
    return _T(spark, sf_dir).select("turn_id", *[c.alias(k) for k, c in f.items()])


QUERIES = {
    "flt5_rejections": lambda s, d: _T(s, d).select("turn_id", X.rejection("role", "text").alias("reason"), X.media_kind("text").alias("media")),
    "flt4_roles": lambda s, d: _T(s, d).groupBy(X.remap("role", {"customer": "buyer", "agent": "seller"}).alias("role")).agg(F.count("*").alias("n")),
    "fn4_messages": fn4_messages,
    "fn12_fields": fn12_fields,
    "fn13_strata": fn13_strata,
    "fn14_scripts": fn14_scripts,
    "wn3_context": wn3_context,
    "ag13_conversations": lambda s, d: P.conversation_counts(_T(s, d)),
    "ag15_census": lambda s, d: P.census(_T(s, d)),
    "ag16_cues": lambda s, d: P.cue_frequencies(_T(s, d)),
    "ag16_words": lambda s, d: P.field_word_frequencies(_T(s, d)),
    "ag17_scripts": lambda s, d: P.script_profile(_T(s, d)),
    "ag18_short_turns": lambda s, d: P.short_turns(_T(s, d)),
}

_ORDER = "PARTITION BY conversation ORDER BY coalesce(turn_index, 2147483648), turn_id"
_SPEAKERS = f"len(list_distinct(list_filter(list(speaker) OVER ({_ORDER} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), lambda s: s <> '')))"
_R = f"r AS (SELECT *, {REASON} AS reason, {_SPEAKERS} AS speakers FROM t)"
_CORR, _HEDGE, _MIX = cue("text", X.CORRECTION_CUES), cue("text", X.HEDGE_CUES), cue("text", X.CODE_MIXED_CUES)
_STRATA = f"CASE WHEN {_CORR} OR {_HEDGE} OR {any_field('text')} OR speakers >= 3 THEN concat_ws(',', CASE WHEN {_CORR} THEN 'correction' END, CASE WHEN {any_field('text')} THEN 'field_mention' END, CASE WHEN {_HEDGE} THEN 'hedge' END, CASE WHEN speakers >= 3 THEN 'multi_speaker' END) ELSE 'plain' END"
_E = f"WITH {TURNS}, {_R}, e AS (SELECT * FROM r WHERE reason IS NULL), "
_OK = f"WITH {TURNS}, e AS (SELECT text FROM (SELECT text, {REASON} AS reason FROM t) WHERE reason IS NULL) "
_TEL, _DEV = "regexp_matches(text, '[\\x{0C00}-\\x{0C7F}]')", "regexp_matches(text, '[\\x{0900}-\\x{097F}]')"
_ASCII = "regexp_full_match(text, '(?s)[\\x00-\\x7f]*')"
_NAL = "regexp_matches(regexp_replace(text, '[\\x00-\\x7f]', '', 'g'), '\\pL')"
_OTHER = f"(NOT {_ASCII} AND NOT {_TEL} AND NOT {_DEV})"
_census = {("total", "turns"): "count(*)", ("total", "eligible"): "count_if(reason IS NULL)"}
_census |= {("rejected", x): f"count_if(reason = '{x}')" for x in ("not_customer", "media_placeholder", "empty", "too_short")}
_census |= {("media", x): f"count_if(reason = 'media_placeholder' AND {MEDIA_KIND} = '{x}')" for x in X.MEDIA_ORDER}
_census |= {("stratum", x): f"count_if(reason IS NULL AND list_contains(string_split(strata, ','), '{x}'))" for x in X.STRATA}
_census |= {("field", x): f"count_if(reason IS NULL AND {field('text', x)})" for x in sorted(X.FIELD_WORDS)}
_census |= {("code_mixed", "any"): f"count_if(reason IS NULL AND {_MIX})"}
_cues = {("correction", c): f"count_if({cue('text', (c,))})" for c in X.CORRECTION_CUES} | {("hedge", c): f"count_if({cue('text', (c,))})" for c in X.HEDGE_CUES}

ORACLES = {
    "flt5_rejections": f"WITH {TURNS} SELECT turn_id, {REASON} AS reason, CASE WHEN {MEDIA} THEN {MEDIA_KIND} END AS media FROM t",
    "flt4_roles": f"WITH {TURNS} SELECT CASE role WHEN 'customer' THEN 'buyer' WHEN 'agent' THEN 'seller' ELSE role END AS role, count(*) AS n FROM t GROUP BY 1",
    "fn4_messages": f"WITH {TURNS} SELECT turn_id, substr(sha256({message('text')}), 1, 12) AS message_hash, {words('text')}::BIGINT AS words, substr(sha256(regexp_replace({message('text')}, '\\p{{Nd}}+', '#', 'g')), 1, 12) AS template_hash FROM t",
    "fn12_fields": f"WITH {TURNS} SELECT turn_id, concat_ws(',', " + ", ".join(f"CASE WHEN {field('text', f)} THEN '{f}' END" for f in sorted(X.FIELD_WORDS)) + ") AS fields FROM t",
    "fn13_strata": f"WITH {TURNS}, {_R} SELECT turn_id, {_STRATA} AS strata FROM r WHERE reason IS NULL",
    "fn14_scripts": f"WITH {TURNS} SELECT turn_id, {_TEL} AS telugu, {_DEV} AS devanagari, {_OTHER} AS other_non_ascii, {_ASCII} AS ascii_only, {_NAL} AS non_ascii_letter FROM t",
    "wn3_context": f"WITH {TURNS}, c AS (SELECT turn_id, list(role || ': ' || text) OVER ({_ORDER} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS ctx, {_SPEAKERS} AS speakers FROM t) SELECT turn_id, coalesce(len(ctx), 0)::INT AS n_context, speakers::INT AS speakers, sha256(coalesce(array_to_string(ctx, chr(10)), '')) AS context_hash FROM c",
    "ag13_conversations": f"WITH {TURNS}, p AS (SELECT conversation, role, count(*) AS n, count_if({REASON} IS NULL) AS ok FROM t GROUP BY 1, 2) SELECT conversation, sum(n)::BIGINT AS turns, sum(ok)::BIGINT AS eligible, array_to_string(list_sort(list(role || '=' || n)), ',') AS roles FROM p GROUP BY 1",
    "ag15_census": f"WITH {TURNS}, {_R}, s AS (SELECT *, CASE WHEN reason IS NULL THEN {_STRATA} END AS strata FROM r) {long('s', _census)}",
    "ag16_cues": _OK + long("e", _cues),
    "ag17_scripts": _OK + long("e", {("all", "turns"): "count(*)", ("script", "telugu"): f"count_if({_TEL})", ("script", "devanagari"): f"count_if({_DEV})", ("script", "other_non_ascii"): f"count_if({_OTHER})", ("script", "ascii_only"): f"count_if({_ASCII})", ("script", "non_ascii_letter"): f"count_if({_NAL})", ("script", "symbols_only"): f"count_if({_OTHER} AND NOT {_NAL})"}),
    "ag18_short_turns": f"WITH {TURNS}, e AS (SELECT text FROM (SELECT text, {REASON} AS reason FROM t) WHERE reason = 'too_short') " + long("e", {("all", "turns"): "count(*)", ("cue", "correction"): f"count_if({_CORR})", ("cue", "hedge"): f"count_if({_HEDGE})", ("words", "one"): f"count_if({words('text')} = 1)", ("words", "two"): f"count_if({words('text')} = 2)", ("script", "ascii_only"): f"count_if({_ASCII})"}),
}

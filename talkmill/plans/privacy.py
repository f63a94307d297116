"""Rule-based spans of personal data over whole messages."""

from pyspark.sql import functions as F

from talkmill.common import norm_id, table
from talkmill.operators import scrub as R


def _rows(spark, sf_dir):
    """All messages, by conversation whatever the spelling of its id. One without a conversation id is a conversation of its own: nothing says what it belongs to."""
    m = table(spark, sf_dir, "messages")
    own = F.coalesce(F.concat(F.lit("id:"), norm_id("source_conversation_id")), F.concat(F.lit("row:"), F.col("message_id").cast("string")))
    return m.select(own.alias("conversation"), F.col("message_id").alias("turn"), "speaker", "role", "text")


def pi1_mails(spark, sf_dir):
    """Addresses by kind, through the span function."""
    from talkmill.functions.spans import found_spans

    s = table(spark, sf_dir, "messages").select("message_id", "text", F.explode(found_spans(F.col("text"))).alias("s")).filter("s.category in ('EMAIL', 'UPI', 'IFSC')")
    return s.select("message_id", F.col("s.category").alias("category"), F.expr("substring(text, s.first + 1, s.end - s.first)").alias("value"))


def _scrubbed(spark, sf_dir):
    """Turns and audit, with the names of each conversation's speakers."""
    from talkmill.common import written

    rows = _rows(spark, sf_dir)
    return R.scrub(rows, people=written(R.rosters(rows)))


def ag20_replacements(spark, sf_dir):
    return R.replacement_counts(_scrubbed(spark, sf_dir)[1])


def pi11_scrubbed(spark, sf_dir):
    return _scrubbed(spark, sf_dir)[0].select("turn", "clean")


def ag20_residual(spark, sf_dir):
    return R.residual(_scrubbed(spark, sf_dir)[0], roster="roster")


def pi13_speakers(spark, sf_dir):
    """Speakers of the conversations that have an id, numbered over the turns with text, as in its SQL."""
    m = table(spark, sf_dir, "messages").filter("source_conversation_id is not null and text is not null")
    return R.speakers(m.select(F.col("source_conversation_id").alias("conversation"), F.col("message_id").alias("turn"), "speaker", "role"))


QUERIES = {"pi1_mails": pi1_mails, "pi11_scrubbed": pi11_scrubbed, "pi13_speakers": pi13_speakers, "ag20_replacements": ag20_replacements, "ag20_residual": ag20_residual}

ORACLES = {
    "pi1_mails": r"SELECT message_id, CASE WHEN value SIMILAR TO '[A-Z]{4}0[A-Z0-9]{6}' THEN 'IFSC' WHEN contains(string_split(value, '@')[2], '.') THEN 'EMAIL' ELSE 'UPI' END AS category, value FROM (SELECT message_id, unnest(list_concat(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]{2,}@[A-Za-z0-9.-]{2,}\b'), regexp_extract_all(text, '\b[A-Z]{4}0[A-Z0-9]{6}\b'))) AS value FROM messages WHERE text IS NOT NULL)",
    "pi13_speakers": "WITH f AS (SELECT source_conversation_id AS conversation, speaker, min(message_id) AS t, min(nullif(trim(role), '')) AS own FROM messages WHERE source_conversation_id IS NOT NULL AND text IS NOT NULL AND speaker IS NOT NULL GROUP BY 1, 2) SELECT conversation, speaker, 'SPEAKER_' || row_number() OVER (PARTITION BY conversation ORDER BY t, speaker) AS speaker_id, coalesce(own, 'unknown') AS role FROM f",
}

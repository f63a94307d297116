"""Agreement of two annotators, and of every pair of them. Labels are taken as written, trimmed; those outside the vocabulary are unlabelled."""

from pyspark.sql import functions as F

from talkmill.common import table
from talkmill.functions.text import blank_to_null
from talkmill.operators import gates
from talkmill.operators import stats as S

A, B = "ANN-03", "ANN-12"


def _sheet(spark, sf_dir, who):
    """One judgement for each item: the first annotation."""
    rows = table(spark, sf_dir, "annotations").filter(F.col("annotator_id") == who)
    label = F.trim("label")
    first = rows.groupBy("item_id").agg(F.min_by(F.struct("conversation_id", F.when(label.isin(*S.LABELS), label).alias("label"), blank_to_null("value").alias("value")), "annotation_id").alias("x"))
    return first.select("item_id", "x.*")


def _both(spark, sf_dir):
    return S.aligned(_sheet(spark, sf_dir, A), _sheet(spark, sf_dir, B))


def _pairs(spark, sf_dir):
    return _both(spark, sf_dir).filter("state = 'both'")


def st14_report(spark, sf_dir):
    return S.agreement_report(_both(spark, sf_dir).withColumn("field", F.element_at(F.split("item_id", ":"), -1)), "field")


QUERIES = {
    "jn4_alignment": lambda s, d: S.alignment_counts(_both(s, d)),
    "st1_kappa": lambda s, d: S.kappa(_pairs(s, d)),
    "st2_categories": lambda s, d: S.category_kappas(_pairs(s, d)),
    "ag22_confusion": lambda s, d: S.confusion(_pairs(s, d)),
    "st13_values": lambda s, d: S.value_agreement(_both(s, d)),
    "st14_report": st14_report,
    "st15_disagreements": lambda s, d: S.disagreements(_both(s, d)),
    "st4_bootstrap": lambda s, d: S.bootstrap_kappa(_pairs(s, d)),
    "st4_bootstrap_items": lambda s, d: S.bootstrap_kappa(_pairs(s, d), unit=None),
    "gt8_agreement": lambda s, d: gates.agreement_gate(S.category_kappas(_pairs(s, d)), S.ABSTENTIONS, S.KAPPA_THRESHOLD, S.MIN_N),
}

_L = ", ".join(f"'{x}'" for x in S.LABELS)


def _side(who: str, s: str) -> str:
    return f"{s} AS (SELECT item_id, conversation_id AS conversation_{s}, CASE WHEN trim(label) IN ({_L}) THEN trim(label) END AS label_{s}, nullif(trim(value), '') AS value_{s}, true AS in_{s} FROM annotations WHERE annotator_id = '{who}' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY annotation_id) = 1)"


_BOTH = f"{_side(A, 'a')}, {_side(B, 'b')}, m AS (SELECT *, CASE WHEN in_b IS NULL THEN 'only_a' WHEN in_a IS NULL THEN 'only_b' WHEN label_a IS NULL OR label_b IS NULL THEN 'unlabelled' WHEN coalesce(conversation_a, '') <> coalesce(conversation_b, '') THEN 'mismatch' ELSE 'both' END AS state FROM a FULL JOIN b USING (item_id)), p AS (SELECT *, string_split(item_id, ':')[-1] AS field FROM m WHERE state = 'both')"


def _kappa(where: str, subset: str | None = None) -> str:
    extra = f", {subset} AS subset" if subset else ""
    return f"SELECT n, observed, expected, CASE WHEN n > 0 AND expected <> 1 THEN (observed - expected) / (1 - expected) END AS kappa{extra} FROM (SELECT (SELECT count(*) FROM p WHERE {where}) AS n, (SELECT count_if(label_a = label_b) / nullif(count(*), 0) FROM p WHERE {where}) AS observed, (SELECT coalesce(sum(x.c * y.c), 0) FROM (SELECT label_a AS l, count(*) AS c FROM p WHERE {where} GROUP BY 1) x JOIN (SELECT label_b AS l, count(*) AS c FROM p WHERE {where} GROUP BY 1) y USING (l)) / nullif((SELECT count(*) * count(*) FROM p WHERE {where}), 0) AS expected)"


_CAT = "c AS (" + " UNION ALL ".join(f"SELECT '{x}' AS label, count_if(label_a = '{x}')::BIGINT AS n_a, count_if(label_b = '{x}')::BIGINT AS n_b, count_if(label_a = '{x}' AND label_b = '{x}')::BIGINT AS n_both, count(*) AS n FROM p" for x in S.LABELS) + "), k AS (SELECT label, n_a, n_b, n_a + n_b - n_both AS n_either, n_both, (n - n_a - n_b + 2 * n_both) / nullif(n, 0) AS po, (n_a * n_b + (n - n_a) * (n - n_b)) / nullif(n * n, 0) AS pe, n FROM c), kk AS (SELECT label, n_a, n_b, n_either, n_both, CASE WHEN n > 0 AND pe <> 1 THEN (po - pe) / (1 - pe) END AS kappa FROM k)"
_STRICT = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'), ' .,;:!?-–—' || chr(9) || chr(10) || chr(13))"

ORACLES = {
    "jn4_alignment": f"WITH {_BOTH} SELECT " + ", ".join(f"count_if(state = '{x}')::BIGINT AS {x}" for x in ("both", "only_a", "only_b", "unlabelled", "mismatch")) + " FROM m",
    "st1_kappa": f"WITH {_BOTH} {_kappa('true')}",
    "st2_categories": f"WITH {_BOTH}, {_CAT} SELECT * FROM kk",
    "ag22_confusion": f"WITH {_BOTH}, l AS (SELECT unnest([{_L}]) AS l) SELECT x.l AS label_a, y.l AS label_b, (SELECT count(*) FROM p WHERE label_a = x.l AND label_b = y.l) AS n FROM l x, l y",
    "st14_report": f"WITH {_BOTH} {_kappa('true', chr(39) + 'combined' + chr(39))} UNION ALL " + " UNION ALL ".join(_kappa(f"field = '{f}'", f"'{f}'") for f in ("budget", "property_type", "location_preference", "timeline", "decision_maker")),
    "st15_disagreements": f"WITH {_BOTH}, d AS (SELECT item_id, CASE WHEN label_a <> label_b THEN 'label' WHEN label_a = 'VALUE' AND {_STRICT('value_a')} <> {_STRICT('value_b')} THEN 'value' END AS kind, label_a, label_b, value_a, value_b FROM p) SELECT * FROM d WHERE kind IS NOT NULL",
    "gt8_agreement": f"WITH {_BOTH}, {_CAT} SELECT label, CASE WHEN n_either < 10 OR kappa IS NULL THEN 'NOT_INTERPRETABLE' WHEN kappa >= 0.6 - 1e-9 THEN 'MEETS' ELSE 'BELOW' END AS verdict FROM kk WHERE label LIKE 'ABSTAIN%'",
}

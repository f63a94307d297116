"""Reports over whole tables: lengths, word counts, scripts, times, agreement of all annotators, gates, spans by value, fingerprints."""

from pyspark.sql import functions as F

from talkmill.common import table
from talkmill.functions import text as X
from talkmill.operators import extract as E
from talkmill.operators import gates
from talkmill.operators import match as M
from talkmill.operators import profile as P
from talkmill.operators import sampling as A
from talkmill.operators import stats as S
from talkmill.plans import scoring
from talkmill.plans.fragments import ITEMS, MEDIA, MEDIA_KIND, REASON, TURNS, any_field, block, cue, long, words
from talkmill.plans.sampling import ORACLES as SAMPLING
from talkmill.plans.sampling import sm5_orders
from talkmill.plans.turns import _ASCII, _DEV, _NAL, _OTHER, _TEL

_T = lambda s, d: P.turns_of(table(s, d, "syn_020"))
COSINE = 0.3


def ag12_models(spark, sf_dir):
    """Every twentieth vector against all, by the whole vector and by its first half."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.slice("embedding", 1, 32).alias("half"))
    near = lambda name, c: M.nearest_by_cosine(e.filter("vec_id % 20 = 0"), e, vector=c).select(F.col("vec_id").alias("key"), F.lit(name).alias("model"), "nearest", (F.round("cosine", 9) >= COSINE).alias("clears"))
    return gates.model_agreement(near("half", "half").unionByName(near("whole", "embedding")))


def _sheets(spark, sf_dir):
    """One judgement for each item and annotator: the first annotation, by the vocabulary as written."""
    label = F.trim("label")
    rows = table(spark, sf_dir, "annotations").filter("item_id is not null and annotator_id is not null")
    first = rows.groupBy("item_id", "annotator_id").agg(F.min_by(F.struct("conversation_id", F.when(label.isin(*S.LABELS), label).alias("label")), "annotation_id").alias("x"))
    return first.select("item_id", "annotator_id", "x.*")


def st1_pairs(spark, sf_dir):
    return S.kappa_by(S.annotator_pairs(_sheets(spark, sf_dir)), ["annotator_a", "annotator_b"])


def st14_labels(spark, sf_dir):
    """Over all pairs of annotators: each label against the rest, by field and in all, with the verdict."""
    p = S.annotator_pairs(_sheets(spark, sf_dir)).withColumn("subset", F.explode(F.array(F.lit("combined"), F.element_at(F.split("item_id", ":"), -1))))
    k = S.category_kappas_by(p, ["subset"])
    verdict = F.when((F.col("n_either") < S.MIN_N) | F.col("kappa").isNull(), "NOT_INTERPRETABLE").when(S.meets(F.col("kappa")), "MEETS").otherwise("BELOW")
    return k.withColumn("verdict", verdict)


def _digests(spark, sf_dir):
    """Per file: rows, and eight sums over the words of the rows' digests, so that neither order nor layout of rows matters."""
    row = F.sha2(F.concat_ws(":", F.coalesce(F.col("source_row").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))), 256)
    word = lambda k: F.sum(F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("bigint")).cast("string")
    m = table(spark, sf_dir, "messages").groupBy(F.coalesce("source_file", F.lit("")).alias("name"))
    return m.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[word(k) for k in range(8)]), 256).alias("digest"))


def ma6_corpus(spark, sf_dir):
    """One fingerprint of all source files: name and digest of each, folded in order of names."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda x: F.concat(x["name"], F.lit(":"), x["digest"], F.lit("\n")))
    return _digests(spark, sf_dir).agg(F.count("*").alias("files"), F.sum("n").alias("rows"), F.sha2(F.array_join(lines, ""), 256).alias("sha256"))  # a row for each file


def gt5_gate(spark, sf_dir):
    """Is the keyword system better than the majority, and is there headroom below a ceiling of 0.95."""
    best = S.accuracy(scoring._scored(spark, sf_dir).filter("system = 'keywords'")).select("accuracy").first()
    row = S.compared(scoring._scored(spark, sf_dir), "keywords", "majority")
    return gates.two_part_gate(row, best[0] if best else None, 0.95)


def gt6_constraint(spark, sf_dir):
    from talkmill.operators import baselines as B

    items = scoring._items(spark, sf_dir)
    failures = B.parse_failures(scoring._predictions(items), table(spark, sf_dir, "action_catalog").select(F.col("action_name").alias("action")))
    return gates.constraint_check(failures, "keywords", "price_first")


def _values(spark, sf_dir, *kinds):
    from talkmill.functions.spans import found_spans

    s = table(spark, sf_dir, "messages").select("message_id", "text", F.explode(found_spans(F.col("text"))).alias("s")).filter(F.col("s.category").isin(*kinds))
    return s.select("message_id", F.col("s.category").alias("category"), F.expr("substring(text, s.first + 1, s.end - s.first)").alias("value"))


def pi4_numbers(spark, sf_dir):
    """Cards, accounts and phones by value."""
    return _values(spark, sf_dir, "CARD", "ACCOUNT", "PHONE")


def pi7_pins(spark, sf_dir):
    """Pin codes: addresses of six digits that follow no premise word."""
    return _values(spark, sf_dir, "ADDRESS").filter(F.col("value").rlike("^[1-9][0-9]{5}$")).distinct()


def dt2_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("ts").cast("string").alias("written"))
    return e.select("event_id", E.time_of(e, "ts").alias("typed"), E.time_of(e, "written").alias("cast_time"))


QUERIES = {
    "ag12_models": ag12_models, "ag13_times": lambda s, d: P.conversation_times(_T(s, d)), "ag17_shares": lambda s, d: P.script_shares(_T(s, d)), "ag18_words": lambda s, d: P.field_word_frequencies(_T(s, d), "too_short"),
    "ag19_diagnostics": lambda s, d: P.cue_diagnostics(_T(s, d)), "st1_pairs": st1_pairs, "st14_labels": st14_labels, "ma6_corpus": ma6_corpus, "gt5_gate": gt5_gate, "gt6_constraint": gt6_constraint,
    "pi3_references": lambda s, d: _values(s, d, "TXNREF"), "pi4_numbers": pi4_numbers, "pi6_amounts": lambda s, d: _values(s, d, "AMOUNT"), "pi7_pins": pi7_pins, "dt2_times": dt2_times,
    "fn18_inputs": lambda s, d: table(s, d, "field_catalog").select("field_name", X.embedding_input("field_name", "field_description").alias("input")), "sm5_distinct": lambda s, d: A.orders_report(sm5_orders(s, d)),
    "wn8_orders": lambda s, d: E.out_of_order(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", ["o_orderkey"]),
}

_L = ", ".join(f"'{x}'" for x in S.LABELS)
_OKT = f"WITH {TURNS}, e AS (SELECT * FROM (SELECT *, {REASON} AS reason FROM t) WHERE reason IS NULL) "


def _word_counts(reason: str) -> dict:
    own = lambda w: f"count_if(regexp_matches(text, '(?i)(^|[^a-z])(?:{w.replace(chr(39), chr(39) * 2)})($|[^a-z])'))"
    out = {(f, w): own(w) for f in sorted(X.FIELD_WORDS) for w in X.FIELD_WORDS[f]}
    nw = r"[^\pL\pN_]"
    out["pattern", "amount"] = f"count_if(regexp_matches(text, '(?i)[0-9][0-9,.]*\\s*(?:thousand|crores|lakhs|crore|lakh|lacs|lac|cr|k|l)($|{nw})'))"
    out["pattern", "locality_suffix"] = rf"count_if(regexp_matches(text, '(?i)(^|{nw})[\pL\pN_]{{3,}}(?:{'|'.join(X.LOCALITY_ENDINGS)})($|{nw})'))"
    return out


def _counted(reason: str) -> str:
    return f"WITH {TURNS}, e AS MATERIALIZED (SELECT text FROM (SELECT text, {REASON} AS reason FROM t) WHERE reason {reason}) " + long("e", _word_counts(reason))


_FLAGS = {"telugu": _TEL, "devanagari": _DEV, "other_non_ascii": _OTHER, "ascii_only": _ASCII, "non_ascii_letter": _NAL}
_KINDS = {"correction": X.CORRECTION_CUES, "hedge": X.HEDGE_CUES, "code_mixed": X.CODE_MIXED_CUES}
_FORMS = {k: " + ".join(f"coalesce(bool_or({cue('text', (c,))}), false)::BIGINT" for c in cues) for k, cues in _KINDS.items()}
_PAIRS = f"""j AS (SELECT item_id, annotator_id, conversation_id, CASE WHEN trim(label) IN ({_L}) THEN trim(label) END AS label FROM annotations WHERE item_id IS NOT NULL AND annotator_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id, annotator_id ORDER BY annotation_id) = 1),
pr AS (SELECT a.item_id, a.annotator_id AS annotator_a, b.annotator_id AS annotator_b, a.label AS label_a, b.label AS label_b FROM j a JOIN j b USING (item_id) WHERE a.annotator_id < b.annotator_id AND a.label IS NOT NULL AND b.label IS NOT NULL AND coalesce(a.conversation_id, '') = coalesce(b.conversation_id, ''))"""


def _near(name: str, vector: str) -> str:
    return f"(SELECT vec_id, nearest, round(c, 9) >= {COSINE} AS clears, '{name}' AS model FROM (SELECT a.vec_id, b.vec_id AS nearest, round(list_cosine_similarity(a.{vector}, b.{vector}), 12) AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.{vector}, b.{vector}), 12) DESC, b.vec_id) AS k FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE k = 1)"


_TIME = SAMPLING["dt1_parsed"].split("SELECT message_id, ", 1)[1].split(" AS parsed FROM", 1)[0]
_SCORED, _COMPARED = scoring._ALL, scoring._CMP
ORACLES = {
    "ag5_lengths": f"WITH {ITEMS}, l AS (SELECT length(reply)::BIGINT AS chars, {words('reply')}::BIGINT AS words FROM i WHERE reply IS NOT NULL) SELECT 'chars' AS unit, * FROM ({block('l', 'chars')}) UNION ALL SELECT 'words' AS unit, * FROM ({block('l', 'words')})",
    "ag12_models": f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS w, embedding[1:32]::DOUBLE[] AS h FROM embeddings), n AS ({_near('half', 'h')} UNION ALL {_near('whole', 'w')}), p AS (SELECT count(*) AS n, avg((a.nearest = b.nearest)::INT) * 100 AS top1, avg((a.clears = b.clears)::INT) AS po, avg(a.clears::INT) AS x, avg(b.clears::INT) AS y FROM n a JOIN n b USING (vec_id) WHERE a.model < b.model) SELECT model, count(*) AS n, avg(clears::INT) * 100 AS clear_rate, NULL::DOUBLE AS top1, NULL::DOUBLE AS kappa FROM n GROUP BY 1 UNION ALL SELECT 'half|whole', n, NULL, top1, CASE WHEN x * y + (1 - x) * (1 - y) <> 1 THEN (po - x * y - (1 - x) * (1 - y)) / (1 - x * y - (1 - x) * (1 - y)) END FROM p",
    "ag13_times": f"WITH {TURNS}, p AS (SELECT conversation, CASE WHEN {MEDIA} THEN {MEDIA_KIND} END AS kind, {_TIME} AS w FROM (SELECT t.*, trim(s.timestamp) AS x FROM t JOIN syn_020 s USING (turn_id))), k AS (SELECT conversation, kind, count(*) AS n, min(w) AS lo, max(w) AS hi FROM p GROUP BY 1, 2) SELECT conversation, min(lo) AS first, max(hi) AS last, coalesce(array_to_string(list_sort(list(kind || '=' || n) FILTER (kind IS NOT NULL)), ','), '') AS kinds FROM k GROUP BY 1",
    "ag16_words": _counted("IS NULL"),
    "ag17_shares": _OKT + ", p AS (SELECT 'eligible' AS population, text FROM e UNION ALL SELECT 'field_mentioning', text FROM e WHERE " + any_field("text") + ") " + " UNION ALL ".join(f"SELECT population, '{k}' AS bucket, count_if({f})::BIGINT AS n, round(count_if({f}) / count(*), 4) AS share FROM p GROUP BY 1" for k, f in _FLAGS.items()),
    "ag18_words": _counted("= 'too_short'"),
    "ag19_diagnostics": _OKT + f", a AS (SELECT count(*) AS n, {', '.join(f'{e} AS {k}' for k, e in _FORMS.items())} FROM e) SELECT 'turns' AS section, 'eligible' AS name, n FROM a " + " ".join(f"UNION ALL SELECT 'forms', '{k}', {k} FROM a" for k in _KINDS) + " UNION ALL SELECT 'cue', 'no_cue_matched', (correction + hedge = 0)::BIGINT FROM a",
    "st1_pairs": f"WITH {_PAIRS}, t AS (SELECT annotator_a, annotator_b, count(*) AS n, count_if(label_a = label_b) AS same FROM pr GROUP BY 1, 2), r AS (SELECT annotator_a, annotator_b, label_a AS l, count(*) AS c FROM pr GROUP BY 1, 2, 3), s AS (SELECT annotator_a, annotator_b, label_b AS l, count(*) AS c FROM pr GROUP BY 1, 2, 3), x AS (SELECT annotator_a, annotator_b, sum(r.c * s.c) AS x FROM r JOIN s USING (annotator_a, annotator_b, l) GROUP BY 1, 2), k AS (SELECT annotator_a, annotator_b, n, same / n AS observed, coalesce(x, 0) / (n * n) AS expected FROM t LEFT JOIN x USING (annotator_a, annotator_b)) SELECT *, CASE WHEN expected <> 1 THEN (observed - expected) / (1 - expected) END AS kappa FROM k",
    "st14_labels": f"WITH {_PAIRS}, u AS (SELECT 'combined' AS subset, * FROM pr UNION ALL SELECT string_split(item_id, ':')[-1], * FROM pr), c AS (" + " UNION ALL ".join(f"SELECT subset, '{x}' AS label, count_if(label_a = '{x}')::BIGINT AS n_a, count_if(label_b = '{x}')::BIGINT AS n_b, count_if(label_a = '{x}' AND label_b = '{x}')::BIGINT AS n_both, count(*) AS n FROM u GROUP BY 1" for x in S.LABELS) + "), k AS (SELECT subset, label, n_a, n_b, n_a + n_b - n_both AS n_either, n_both, (n - n_a - n_b + 2 * n_both) / n AS po, (n_a * n_b + (n - n_a) * (n - n_b)) / (n * n) AS pe FROM c), q AS (SELECT * EXCLUDE (po, pe), CASE WHEN pe <> 1 THEN (po - pe) / (1 - pe) END AS kappa FROM k) SELECT *, CASE WHEN n_either < 10 OR kappa IS NULL THEN 'NOT_INTERPRETABLE' WHEN kappa >= 0.6 - 1e-9 THEN 'MEETS' ELSE 'BELOW' END AS verdict FROM q",
    "ma6_corpus": "WITH r AS (SELECT coalesce(source_file, '') AS name, sha256(concat_ws(':', coalesce(source_row::VARCHAR, '-'), coalesce(text, ''))) AS h FROM messages), d AS (SELECT name, count(*) AS n, sha256(concat_ws(':', count(*)::VARCHAR, " + ", ".join(f"sum(('0x' || h[{8 * k + 1}:{8 * k + 8}])::BIGINT)::VARCHAR" for k in range(8)) + ")) AS digest FROM r GROUP BY 1) SELECT count(*) AS files, sum(n)::BIGINT AS rows, sha256(string_agg(name || ':' || digest || chr(10), '' ORDER BY name)) AS sha256 FROM d",
    "gt5_gate": f"{_SCORED}, {_COMPARED}, v AS (SELECT 'needed' AS condition, CASE WHEN diff_pp >= 10 AND p < 0.05 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM cq WHERE a = 'keywords' AND b = 'majority' UNION ALL SELECT 'headroom', CASE WHEN (0.95 - accuracy_a) * 100 >= 10 THEN 'PASS' ELSE 'FAIL' END FROM cq WHERE a = 'keywords' AND b = 'majority') SELECT * FROM v UNION ALL SELECT 'gate', CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' ELSE 'PASS' END FROM v",
    "gt6_constraint": f"WITH {ITEMS}, {scoring._MAJ}, {scoring._PRED}, f AS (SELECT system, count_if(lower(trim(predicted)) NOT IN (SELECT lower(trim(action_name)) FROM action_catalog)) AS n FROM pr GROUP BY 1) SELECT CASE WHEN c IS NULL THEN 'NOT_ESTABLISHED' WHEN c > 0 THEN 'FAIL' WHEN w = 0 THEN 'NOT_ESTABLISHED' ELSE 'PASS' END AS verdict FROM (SELECT max(n) FILTER (system = 'keywords') AS c, max(n) FILTER (system = 'price_first') AS w FROM f)",
    "pi3_references": r"SELECT message_id, 'TXNREF' AS category, unnest(regexp_extract_all(text, '(?i)\b(?:utr|txn|transaction|ref|reference)\s*(?:id|no\.?|number|#)?\s*[:\-]?\s*([A-Za-z0-9]{8,24})\b', 1)) AS value FROM messages WHERE text IS NOT NULL",
    "pi6_amounts": r"SELECT * FROM (SELECT message_id, 'AMOUNT' AS category, unnest(regexp_extract_all(text, '(?i)(?:(?:₹|rs\.?|inr)\s*[\d,]+(?:\.\d+)?(?:\s*(?:lakhs?|lacs?|crores?|cr|k|thousand|mn))?|[\d,]+(?:\.\d+)?\s*(?:lakhs?|lacs?|crores?|cr|k|thousand|mn)\b)')) AS value FROM messages WHERE text IS NOT NULL) WHERE regexp_matches(value, '\d')",
    "pi7_pins": r"SELECT DISTINCT message_id, 'ADDRESS' AS category, value FROM (SELECT message_id, unnest(regexp_extract_all(text, '\d+')) AS value FROM messages WHERE text IS NOT NULL) WHERE regexp_full_match(value, '[1-9]\d{5}')",
    "dt2_times": "SELECT event_id, ts AS typed, ts AS cast_time FROM events",
    "fn18_inputs": "SELECT field_name, field_name || ': ' || coalesce(field_description, '') AS input FROM field_catalog",
    "sm5_distinct": f"WITH o AS ({SAMPLING['sm5_orders']}), s AS (SELECT annotator, string_agg(key::VARCHAR, ',' ORDER BY place) AS keys FROM o GROUP BY 1) SELECT count(*) AS annotators, count(DISTINCT keys) = count(*) AS orders_distinct FROM s",
    "wn8_orders": "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE o_orderdate < p",
}

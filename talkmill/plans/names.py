"""Overlap of names and vectors. Queries are the parts with even keys and references those with odd ones; owners are brands."""

from pyspark.sql import functions as F

from talkmill.common import table
from talkmill.functions import text as X
from talkmill.operators import gates
from talkmill.operators import match as M


def _named(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("owner"), F.concat_ws("_", "p_name", F.initcap("p_type"), F.concat(F.lit("sizes"), (F.col("p_size") % 7).cast("string"))).alias("name"))


def _sides(spark, sf_dir):
    p = _named(spark, sf_dir)
    return p.filter("k % 2 = 0"), p.filter("k % 2 = 1")


def _kinds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    both = p.select(F.col("p_partkey").alias("k"), F.lit("slot").alias("kind"), F.concat_ws("_", "p_name", (F.col("p_size") % 9).cast("string")).alias("name")).unionByName(p.select(F.col("p_partkey").alias("k"), F.lit("intent").alias("kind"), F.concat_ws(" ", "p_type", (F.col("p_size") % 23).cast("string")).alias("name")))
    return both.filter("k % 2 = 0"), both.filter("k % 2 = 1")


def fn1_names(spark, sf_dir):
    return _named(spark, sf_dir).select("k", X.exact_name("name").alias("n0"), X.split_name("name").alias("n1"), X.stem_name("name").alias("n2"))


def jn1_flags(spark, sf_dir):
    q, r = _sides(spark, sf_dir)
    return M.exact_flags(q, r, "N2").select("k", "key", "matched")


def jn2_evidence(spark, sf_dir):
    q, r = _sides(spark, sf_dir)
    return M.evidence(q, r, "N2").select("key", "n", F.array_join("owners", ",").alias("owners"))


def jn3_seen(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("owner", F.concat_ws("/", "p_brand", "p_type"))
    return M.seen_owners(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 2 = 1"))


def jn20_shared(spark, sf_dir):
    return M.shared_frequency(*_sides(spark, sf_dir), "N2")


def jn12_tokens(spark, sf_dir):
    """Every twentieth part against the names of all other parts."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand", F.col("p_size").cast("string")).alias("name"))
    return M.nearest_by_tokens(p.filter("p_partkey % 20 = 0"), p, key="p_partkey")


def jn11_cosine(spark, sf_dir):
    """Every twentieth vector against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return M.nearest_by_cosine(e.filter("vec_id % 20 = 0"), e).select("vec_id", "nearest", F.round("cosine", 4).alias("cosine"))


def _paired(spark, sf_dir):
    """Vectors of a label in key order: the first of each six is an original, the next five its variants."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "embeddings").withColumn("k", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1)
    e = e.select(F.col("label").cast("string").alias("owner"), F.floor(F.col("k") / 6).cast("int").alias("position"), (F.col("k") % 6).cast("int").alias("variant"), F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("vector"))
    return e.filter("variant = 0").drop("variant"), e.filter("variant > 0")


def jn9_pairs(spark, sf_dir):
    return M.paired_by_position(*_paired(spark, sf_dir)).select("owner", "position", "variant", "original", "renamed", F.round("cosine", 6).alias("cosine"))


def ag11_quantiles(spark, sf_dir):
    p = M.paired_by_position(*_paired(spark, sf_dir))
    return p.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("cosine"), 6).alias("mean"), *[F.round(F.percentile("cosine", F.lit(q)), 6).alias(f"p{round(q * 100)}") for q in (0.1, 0.5, 0.9)])


def jn10_problems(spark, sf_dir):
    return M.pairing_problems(*_paired(spark, sf_dir))


def gt1_bands(spark, sf_dir):
    r = M.match_rates(*_kinds(spark, sf_dir)).filter("form = 'N0' and unit = 'instances'")
    return gates.band_gate(r)


def gt2_clear(spark, sf_dir):
    p = M.paired_by_position(*_paired(spark, sf_dir)).filter("variant <= 2")
    flags = p.select(F.col("original").alias("key"), F.col("variant").alias("model"), (F.round("cosine", 6) >= 0.3).alias("clears"))
    return gates.clear_gate(flags)


QUERIES = {
    "fn1_names": fn1_names, "jn1_flags": jn1_flags, "jn1_rates": lambda s, d: M.match_rates(*_kinds(s, d)), "jn2_evidence": jn2_evidence, "jn3_seen": jn3_seen, "jn20_shared": jn20_shared, "jn12_tokens": jn12_tokens,
    "jn11_cosine": jn11_cosine, "jn9_pairs": jn9_pairs, "jn10_problems": jn10_problems, "ag11_quantiles": ag11_quantiles, "gt1_bands": gt1_bands, "gt2_clear": gt2_clear,
}


def _tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[_\\-\\s]+'), lambda x: x <> '')"


_NEVER = ", ".join(f"'{x}'" for x in X.NEVER_SINGULAR)
_STOP = ", ".join(f"'{x}'" for x in X.STOPWORDS)
_SINGULAR = f"CASE WHEN x IN ({_NEVER}) OR length(x) <= 3 THEN x WHEN regexp_matches(x, '(ss|us|is)$') THEN x WHEN x LIKE '%ies' AND length(x) > 4 THEN x[:-4] || 'y' WHEN regexp_matches(x, '(ses|xes|zes|ches|shes)$') THEN x[:-3] WHEN x LIKE '%s' THEN x[:-2] ELSE x END"
_N0, _N1 = "lower(trim(name))", f"array_to_string({_tokens('name')}, ' ')"
_N2 = f"array_to_string(list_filter(list_transform({_tokens('name')}, lambda x: {_SINGULAR}), lambda x: x NOT IN ({_STOP})), ' ')"
_P = "p AS (SELECT p_partkey AS k, p_brand AS owner, concat_ws('_', p_name, upper(p_type[1]) || lower(p_type[2:]), 'sizes' || (p_size % 7)) AS name FROM part), q AS (SELECT * FROM p WHERE k % 2 = 0), r AS (SELECT * FROM p WHERE k % 2 = 1)"
_K = "p AS (SELECT p_partkey AS k, 'slot' AS kind, concat_ws('_', p_name, (p_size % 9)::VARCHAR) AS name FROM part UNION ALL SELECT p_partkey, 'intent', concat_ws(' ', p_type, (p_size % 23)::VARCHAR) FROM part), q AS (SELECT * FROM p WHERE k % 2 = 0), r AS (SELECT * FROM p WHERE k % 2 = 1)"
_RATES = "rates AS (" + " UNION ALL ".join(
    f"SELECT kind, '{f}' AS form, '{u}' AS unit, count(*) AS n, count_if(hit)::BIGINT AS hits, count_if(hit) / count(*) * 100 AS rate FROM (SELECT {d} kind, name, (kind, {e}) IN (SELECT (kind, {e}) FROM r) AS hit FROM q) GROUP BY kind"
    for f, e in (("N0", _N0), ("N1", _N1), ("N2", _N2)) for u, d in (("instances", ""), ("unique", "DISTINCT"))
) + ")"
_E = "e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings), v AS (SELECT label::VARCHAR AS owner, (k // 6)::INT AS position, (k % 6)::INT AS variant, vec_id::VARCHAR AS name, embedding::DOUBLE[] AS vector FROM e), x AS (SELECT a.owner, a.position, b.variant, a.name AS original, b.name AS renamed, list_cosine_similarity(a.vector, b.vector) AS cosine FROM v a JOIN v b USING (owner, position) WHERE a.variant = 0 AND b.variant > 0)"

ORACLES = {
    "fn1_names": f"WITH {_P} SELECT k, {_N0} AS n0, {_N1} AS n1, {_N2} AS n2 FROM p",
    "jn1_flags": f"WITH {_P} SELECT k, {_N2} AS key, {_N2} IN (SELECT {_N2} FROM r) AS matched FROM q",
    "jn1_rates": f"WITH {_K}, {_RATES} SELECT * FROM rates",
    "jn2_evidence": f"WITH {_P}, h AS (SELECT {_N2} AS key, array_to_string(list_sort(list(DISTINCT owner)), ',') AS owners FROM r GROUP BY 1) SELECT key, n, coalesce(owners, '') AS owners FROM (SELECT {_N2} AS key, count(*) AS n FROM q GROUP BY 1) LEFT JOIN h USING (key)",
    "jn3_seen": "WITH p AS (SELECT p_partkey AS k, concat_ws('/', p_brand, p_type) AS owner FROM part) SELECT DISTINCT owner, owner IN (SELECT owner FROM p WHERE k % 2 = 1) AS seen FROM p WHERE k % 2 = 0",
    "jn20_shared": f"WITH {_P} SELECT * FROM (SELECT {_N2} AS key, count(*) AS instances, count(DISTINCT owner) AS query_owners FROM q GROUP BY 1) JOIN (SELECT {_N2} AS key, count(DISTINCT owner) AS reference_owners FROM r GROUP BY 1) USING (key)",
    "jn12_tokens": f"""WITH p AS (SELECT p_partkey AS k, concat_ws(' ', p_name, p_type, p_brand, p_size::VARCHAR) AS name FROM part), q AS (SELECT DISTINCT name, list_distinct({_tokens('name')}) AS t FROM p WHERE k % 20 = 0), r AS (SELECT name, list_distinct({_tokens('name')}) AS t, count(DISTINCT k) AS rows FROM p GROUP BY name),
      s AS (SELECT q.name, r.name AS nearest, len(list_intersect(q.t, r.t)) / len(list_distinct(list_concat(q.t, r.t))) AS score FROM q, r WHERE q.name <> r.name OR r.rows > 1), b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, nearest) AS k FROM s) SELECT name, nearest, score FROM b WHERE k = 1""",
    "jn11_cosine": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS nearest, round(list_cosine_similarity(a.v, b.v), 12) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, nearest) AS k FROM s) SELECT vec_id, nearest, round(c, 4) AS cosine FROM b WHERE k = 1",
    "jn9_pairs": f"WITH {_E} SELECT owner, position, variant, original, renamed, round(cosine, 6) AS cosine FROM x",
    "jn10_problems": f"WITH {_E}, o AS (SELECT owner, count(*) AS n FROM v WHERE variant = 0 GROUP BY 1), g AS (SELECT owner, variant, count(*) AS m FROM v WHERE variant > 0 GROUP BY 1, 2), w AS (SELECT owner, variant, n FROM o, (SELECT DISTINCT variant FROM g)) SELECT variant, owner, CASE WHEN n IS NULL THEN 'unknown owner' WHEN m IS NULL THEN 'missing owner' ELSE 'unequal counts' END AS problem FROM w FULL JOIN g USING (owner, variant) WHERE n IS NULL OR m IS NULL OR n <> m",
    "ag11_quantiles": f"WITH {_E} SELECT variant, count(*) AS n, round(avg(cosine), 6) AS mean, round(quantile_cont(cosine, 0.1), 6) AS p10, round(quantile_cont(cosine, 0.5), 6) AS p50, round(quantile_cont(cosine, 0.9), 6) AS p90 FROM x GROUP BY variant",
    "gt1_bands": f"WITH {_K}, {_RATES} SELECT kind, rate, CASE kind WHEN 'slot' THEN rate BETWEEN 60 AND 70 ELSE rate BETWEEN 66 AND 76 END AS passes FROM rates WHERE form = 'N0' AND unit = 'instances'",
    "gt2_clear": f"WITH {_E}, a AS (SELECT original, bool_and(round(cosine, 6) >= 0.3) AS ok FROM x WHERE variant <= 2 GROUP BY 1) SELECT count(*) AS n, avg(ok::INT::DOUBLE * 100) AS rate, avg(ok::INT::DOUBLE * 100) >= 50 - 1e-9 AS passes FROM a",
}

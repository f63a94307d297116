"""Scoring of rule predictors against the labelled actions, and what surrounds it: baselines, costs, masks, sweeps."""

from pyspark.sql import functions as F

from talkmill.common import table
from talkmill.operators import baselines as B
from talkmill.operators import gates
from talkmill.operators import profile as P
from talkmill.operators import stats as S
from talkmill.operators.sampling import split_by_conversation
from talkmill.plans.fragments import ITEMS

RULES = (("visit", "book_visit"), ("lakh|crore|budget", "query_budget"), ("loan|emi|bank", "loan_help"), ("near|flat in|plot in", "query_location"), ("price|rate", "share_price"))
SYSTEMS = ("keywords", "majority", "price_first")


def _items(spark, sf_dir):
    return P.items_of(table(spark, sf_dir, "items"))


def keyword(c, rules=RULES, rest="clarify"):
    out = F.lit(None).cast("string")
    for pattern, action in rules:
        hit = F.lower(F.coalesce(c, F.lit(""))).rlike(pattern)
        out = F.when(hit, action) if out is None else F.coalesce(out, F.when(hit, action))
    return F.coalesce(out, F.lit(rest))


def _predictions(items):
    m = F.col("user_message")
    one = items.select(F.lit("keywords").alias("system"), "row", keyword(m).alias("predicted"))
    two = items.select(F.lit("price_first").alias("system"), "row", keyword(m, RULES[::-1], "no idea").alias("predicted"))
    return one.unionByName(two).unionByName(B.predict_majority(items, items))


def _scored(spark, sf_dir):
    items = _items(spark, sf_dir)
    return S.scored(items, _predictions(items))


def st8_compare(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    out = S.compared(rows, "keywords", "majority").unionByName(S.compared(rows, "keywords", "price_first")).unionByName(S.compared(rows, "majority", "price_first"))
    return out.withColumn("p", F.round("p", 8))


def st9_holm(spark, sf_dir):
    rows = st8_compare(spark, sf_dir).select(F.concat_ws("-", "a", "b").alias("name"), "p")
    return S.holm(rows)


def st7_mcnemar(spark, sf_dir):
    grid = spark.range(0, 41).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("id"))).alias("b"), F.col("id").alias("c"))
    return grid.select("b", "c", F.round(S.mcnemar(F.col("b"), F.col("c")), 8).alias("p"))


def st5_bootstrap(spark, sf_dir):
    return S.bootstrap_accuracy(_scored(spark, sf_dir).filter("system = 'keywords'"))


def st11_wilcoxon(spark, sf_dir):
    """Whether replies of a source are shorter than messages: paired lengths."""
    rows = _items(spark, sf_dir).filter("labeler is not null").select("labeler", F.length(F.coalesce("user_message", F.lit(""))).cast("double").alias("x"), F.length(F.coalesce("reply", F.lit(""))).cast("double").alias("y"))
    return S.wilcoxon_less(rows, "x", "y", ["labeler"]).select("labeler", "n", "w_plus", F.round("p", 9).alias("p"))


def wn9_inversions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return P.inversions(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")


def ag27_costs(spark, sf_dir):
    calls = _predictions(_items(spark, sf_dir)).join(_items(spark, sf_dir).select("row", F.length(F.coalesce("user_message", F.lit(""))).alias("tokens_in"), F.length(F.coalesce("reply", F.lit(""))).alias("tokens_out")), "row").withColumn("latency_ms", F.col("row") % 1000)
    return B.costs(calls, input_price=0.5, output_price=1.5).select("system", "n", "tokens_in", "tokens_out", F.round("cost", 8).alias("cost"), F.round("cost_per_item", 12).alias("cost_per_item"), F.round("latency_ms", 6).alias("latency_ms"))


def _masks(spark, sf_dir):
    ids = lambda c: F.sequence(F.lit(1), F.size(F.split(F.trim(c), r"\s+"))).cast("array<int>")
    rows = _items(spark, sf_dir).filter("user_message is not null and reply is not null")
    return rows.select("row", B.masked(ids("user_message"), ids("reply")).alias("m")).select("row", "m.*")


def ma4_masks(spark, sf_dir):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return _masks(spark, sf_dir).select("row", F.size("inputs").alias("positions"), F.element_at("inputs", -1).alias("last_input"), F.element_at("targets", -1).alias("last_target"), total("weights").alias("weighted"))


def ma5_tokens(spark, sf_dir):
    return B.token_ids(_items(spark, sf_dir).filter("user_message is not null"), "row", "user_message").select("row", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def _runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.lit(1e-5) * (F.col("o_custkey") % 3 + 1)).alias("lr"), (F.col("o_orderkey") % 3).cast("int").alias("seed"), (F.month("o_orderdate") % 10 + 1).cast("int").alias("epoch")).agg((F.count_if(F.col("o_totalprice") > 150000) / F.count("*")).alias("accuracy"))


QUERIES = {
    "ag23_by_class": lambda s, d: S.by_class(_scored(s, d)),
    "ag24_accuracy": lambda s, d: S.accuracy(_scored(s, d)),
    "ag24_spread": lambda s, d: B.spread(table(s, d, "supplier"), "s_acctbal", ["s_nationkey"]).select("s_nationkey", F.round("mean", 6).alias("mean"), "min", "max", F.round("stdev", 6).alias("stdev")),
    "ag25_majority": lambda s, d: B.majority(_items(s, d)),
    "ag26_parse_failures": lambda s, d: B.parse_failures(_predictions(_items(s, d)), table(s, d, "action_catalog").select(F.col("action_name").alias("action"))),
    "ag27_costs": ag27_costs,
    "ag28_mask_totals": lambda s, d: B.mask_totals(_masks(s, d)),
    "ag29_rate": lambda s, d: B.selected_rate(B.best_epochs(_runs(s, d))).select(F.round("lr", 8).alias("lr"), F.round("mean", 10).alias("mean")),
    "ag30_epochs": lambda s, d: B.best_epochs(_runs(s, d)).select(F.round("lr", 8).alias("lr"), "seed", "epoch", "accuracy"),
    "ma4_masks": ma4_masks,
    "ma5_tokens": ma5_tokens,
    "ml1_majority": lambda s, d: B.predict_majority(_items(s, d), _items(s, d)),
    "ml3_floor": lambda s, d: B.floor_of(S.accuracy(_scored(s, d))),
    "st5_bootstrap": st5_bootstrap,
    "st7_mcnemar": st7_mcnemar,
    "st8_compare": st8_compare,
    "st9_holm": st9_holm,
    "st11_wilcoxon": st11_wilcoxon,
    "wn9_inversions": wn9_inversions,
    "gt5_effect": lambda s, d: gates.effect_gate(st8_compare(s, d)).select("a", "b", "passes"),
    "gt7_seeds": lambda s, d: gates.seed_gate(B.best_epochs(_runs(s, d)).select("seed", (F.col("seed") == 0).alias("is_primary"), (F.col("accuracy") > 0.5).alias("passes"))),
}


def ml2_classifier(spark, sf_dir):
    """Predictions of a bag-of-grams classifier trained on the train split by conversation, for the dev and test items."""
    items = _items(spark, sf_dir).filter("action is not null and conversation_id is not null")
    n = items.count()
    split = split_by_conversation(items, {"test": n // 5, "dev": n // 10}, "split-0").select("conversation_id", "split")
    rows = items.select("row", "conversation_id", "user_message", "action").join(split.withColumnRenamed("split", "part"), "conversation_id")
    model = B.text_classifier(rows.filter("part = 'train'"))
    labels = next(s.labels for s in model.stages if hasattr(s, "labels"))
    out = model.transform(rows.filter("part <> 'train'").select("row", F.coalesce("user_message", F.lit("")).alias("_text"), F.col("action").alias("_label")))
    return out.select("row", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1).alias("predicted"))


QUERIES["ml2_classifier"] = ml2_classifier


def _case(rules, rest):
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(user_message, '')), '{p}') THEN '{a}'" for p, a in rules) + f" ELSE '{rest}' END"


_MAJ = "mj AS (SELECT action AS label, count(*) AS n FROM i WHERE action IS NOT NULL GROUP BY 1 ORDER BY n DESC, label DESC LIMIT 1)"
_PRED = f"pr AS (SELECT 'keywords' AS system, row, {_case(RULES, 'clarify')} AS predicted FROM i UNION ALL SELECT 'price_first', row, {_case(RULES[::-1], 'no idea')} FROM i UNION ALL SELECT 'majority', row, (SELECT label FROM mj) FROM i)"
_SC = "sc AS (SELECT system, row, conversation_id, action AS gold, predicted, coalesce(predicted = action, false) AS correct FROM pr JOIN i USING (row) WHERE action IS NOT NULL)"
_ALL = f"WITH {ITEMS}, {_MAJ}, {_PRED}, {_SC}"
_TAIL = "least(1.0, 2 * list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2)) for j in range(0, k + 1)]))"


def _cmp(a: str, b: str) -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, count_if(x.correct) / count(*) AS accuracy_a, count_if(y.correct) / count(*) AS accuracy_b, 100 * (count_if(x.correct) / count(*) - count_if(y.correct) / count(*)) AS diff_pp, count_if(x.correct AND NOT y.correct)::BIGINT AS only_a, count_if(NOT x.correct AND y.correct)::BIGINT AS only_b FROM sc x JOIN sc y USING (row) WHERE x.system = '{a}' AND y.system = '{b}'"


_CMP = f"cm AS ({_cmp('keywords', 'majority')} UNION ALL {_cmp('keywords', 'price_first')} UNION ALL {_cmp('majority', 'price_first')})"
_W = "ps AS (SELECT labeler, length(coalesce(user_message, ''))::DOUBLE - length(coalesce(reply, ''))::DOUBLE AS d FROM i WHERE labeler IS NOT NULL), nz AS (SELECT labeler, d, abs(d) AS m FROM ps WHERE d <> 0), rk AS (SELECT *, rank() OVER (PARTITION BY labeler ORDER BY m) + (count(*) OVER (PARTITION BY labeler, m) - 1) / 2 AS r FROM nz)"
_RUNS = "rn AS (SELECT 1e-5 * (o_custkey % 3 + 1) AS lr, (o_orderkey % 3)::INT AS seed, (month(o_orderdate) % 10 + 1)::INT AS epoch, count_if(o_totalprice > 150000) / count(*) AS accuracy FROM orders GROUP BY ALL), g1 AS (SELECT *, max(accuracy) OVER w AS before FROM rn WINDOW w AS (PARTITION BY lr, seed ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g2 AS (SELECT *, epoch - max(CASE WHEN before IS NULL OR accuracy > before THEN epoch END) OVER (PARTITION BY lr, seed ORDER BY epoch) AS since FROM g1), g3 AS (SELECT *, coalesce(max((since >= 2)::INT) OVER (PARTITION BY lr, seed ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM g2), be AS (SELECT lr, seed, arg_max(epoch, (accuracy, -epoch)) AS epoch, max(accuracy) AS accuracy FROM g3 WHERE stop = 0 GROUP BY 1, 2)"
_WORDS = "len(regexp_split_to_array(trim({c}), '\\s+'))"

ORACLES = {
    "ag23_by_class": f"{_ALL} SELECT system, gold, count(*) AS support, count_if(correct)::BIGINT AS correct, count_if(correct) / count(*) AS accuracy FROM sc GROUP BY 1, 2",
    "ag24_spread": "SELECT s_nationkey, round(avg(s_acctbal), 6) AS mean, min(s_acctbal) AS min, max(s_acctbal) AS max, round(coalesce(stddev_samp(s_acctbal), 0), 6) AS stdev FROM supplier GROUP BY 1",
    "ag25_majority": f"WITH {ITEMS}, {_MAJ} SELECT * FROM mj",
    "ag26_parse_failures": f"WITH {ITEMS}, {_MAJ}, {_PRED} SELECT system, count(*) AS n, count_if(lower(trim(predicted)) NOT IN (SELECT lower(trim(action_name)) FROM action_catalog))::BIGINT AS failures FROM pr GROUP BY 1",
    "ag27_costs": f"WITH {ITEMS}, {_MAJ}, {_PRED}, c AS (SELECT system, count(*) AS n, sum(length(coalesce(user_message, '')))::BIGINT AS tokens_in, sum(length(coalesce(reply, '')))::BIGINT AS tokens_out, sum(row % 1000) AS l FROM pr JOIN i USING (row) GROUP BY 1) SELECT system, n, tokens_in, tokens_out, round(tokens_in / 1e6 * 0.5 + tokens_out / 1e6 * 1.5, 8) AS cost, round((tokens_in / 1e6 * 0.5 + tokens_out / 1e6 * 1.5) / n, 12) AS cost_per_item, round(l / n, 6) AS latency_ms FROM c",
    "ag28_mask_totals": f"WITH {ITEMS}, m AS (SELECT {_WORDS.format(c='user_message')} AS p, {_WORDS.format(c='reply')} AS c FROM i WHERE user_message IS NOT NULL AND reply IS NOT NULL) SELECT count(*) AS n, sum(c)::DOUBLE AS weighted, sum(p + c - 1)::BIGINT AS positions, sum(c) / sum(p + c - 1) AS share, avg(c) AS mean_weighted FROM m",
    "ag29_rate": f"WITH {_RUNS}, mn AS (SELECT lr, avg(accuracy) AS mean FROM be GROUP BY 1) SELECT round(lr, 8) AS lr, round(mean, 10) AS mean FROM mn ORDER BY mn.mean DESC, mn.lr LIMIT 1",
    "ag30_epochs": f"WITH {_RUNS} SELECT round(lr, 8) AS lr, seed, epoch, accuracy FROM be",
    "ma4_masks": f"WITH {ITEMS}, m AS (SELECT row, {_WORDS.format(c='user_message')} AS p, {_WORDS.format(c='reply')} AS c FROM i WHERE user_message IS NOT NULL AND reply IS NOT NULL) SELECT row, (p + c - 1)::INT AS positions, (CASE WHEN c > 1 THEN c - 1 ELSE p END)::INT AS last_input, c::INT AS last_target, c::DOUBLE AS weighted FROM m",
    "ma5_tokens": f"WITH {ITEMS}, w AS (SELECT row, unnest(regexp_split_to_array(trim(user_message), '\\s+')) AS token, generate_subscripts(regexp_split_to_array(trim(user_message), '\\s+'), 1) AS pos FROM i WHERE user_message IS NOT NULL), f AS (SELECT token, min((row, pos)) AS o FROM w WHERE token <> '' GROUP BY 1), d AS (SELECT token, row_number() OVER (ORDER BY o) - 1 AS id FROM f) SELECT row, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids FROM w JOIN d USING (token) GROUP BY row",
    "ml1_majority": f"WITH {ITEMS}, {_MAJ} SELECT 'majority' AS system, row, (SELECT label FROM mj) AS predicted FROM i",
    "ml3_floor": f"{_ALL}, a AS (SELECT system, count_if(correct) / count(*) AS accuracy FROM sc GROUP BY 1) SELECT system, accuracy FROM a ORDER BY a.accuracy DESC, a.system DESC LIMIT 1",
    "st7_mcnemar": f"WITH g AS (SELECT b.range AS b, c.range AS c, b.range + c.range AS n, least(b.range, c.range) AS k FROM range(0, 41) c, range(0, 41) b WHERE b.range <= c.range) SELECT b, c, round(CASE WHEN n = 0 THEN 1.0 ELSE {_TAIL} END, 8) AS p FROM g",
    "st11_wilcoxon": None,
    "wn9_inversions": "WITH p AS (SELECT o_custkey, o_totalprice AS v, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS q FROM orders) SELECT o_custkey, coalesce(count_if(v > q), 0)::BIGINT AS inversions, coalesce(bool_and(CASE WHEN q IS NOT NULL THEN v < q END), true) AS strictly_decreasing FROM p GROUP BY 1",
    "gt7_seeds": f"WITH {_RUNS} SELECT CASE WHEN NOT coalesce(bool_or(seed = 0), false) THEN 'NOT_ESTABLISHED' WHEN bool_and(accuracy > 0.5) <> bool_or(accuracy > 0.5) THEN 'UNSTABLE' WHEN bool_or(seed = 0 AND accuracy > 0.5) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM be",
}
_Z = "1.96"
ORACLES["ag24_accuracy"] = f"{_ALL}, a AS (SELECT system, count(*) AS n, count_if(correct)::BIGINT AS correct, count_if(correct)::DOUBLE / count(*) AS accuracy FROM sc GROUP BY 1) SELECT *, greatest(0, (accuracy + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(accuracy * (1 - accuracy) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)) AS lo, least(1, (accuracy + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(accuracy * (1 - accuracy) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)) AS hi FROM a"
del ORACLES["st11_wilcoxon"]
_CMP += f", cp AS (SELECT *, only_a + only_b AS n_, least(only_a, only_b) AS k_ FROM cm), cq AS (SELECT * EXCLUDE (n_, k_), round(CASE WHEN n_ = 0 THEN 1.0 ELSE {_TAIL.replace('n + 1', 'n_ + 1').replace('n - j', 'n_ - j').replace('n * ln', 'n_ * ln').replace('k + 1', 'k_ + 1')} END, 8) AS p FROM cp)"
ORACLES["st8_compare"] = f"{_ALL}, {_CMP} SELECT * FROM cq"
ORACLES["st9_holm"] = f"{_ALL}, {_CMP}, h AS (SELECT a || '-' || b AS name, p, row_number() OVER (ORDER BY p, a || '-' || b) AS r, count(*) OVER () AS m FROM cq) SELECT name, p, max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY r) AS p_holm FROM h"
ORACLES["gt5_effect"] = f"{_ALL}, {_CMP} SELECT a, b, diff_pp >= 10 - 1e-9 AND p < 0.05 AS passes FROM cq"

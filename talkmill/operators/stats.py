"""Agreement and comparison statistics, from counts that are aggregated before anything statistical is done."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.common import lookup_rows
from talkmill.functions.values import number_key, strict_key

LABELS = ("NO-OP", "VALUE", "ABSTAIN:insufficient", "ABSTAIN:ambiguous", "ABSTAIN:conflicting", "HEDGED")
ABSTENTIONS = LABELS[2:5]
KAPPA_THRESHOLD, TOLERANCE, MIN_N, MAX_UNDEFINED = 0.6, 1e-9, 10, 0.05
Z95 = 1.96


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sheets (item_id, conversation_id, label, value) side by side, full outer, with `state`: both, only_a, only_b, unlabelled."""
    side = lambda d, s: d.select("item_id", F.col("conversation_id").alias(f"conversation_{s}"), F.col("label").alias(f"label_{s}"), F.col("value").alias(f"value_{s}"), F.lit(True).alias(f"in_{s}"))
    both = side(a, "a").join(side(b, "b"), "item_id", "full_outer")
    state = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").when(F.col("label_a").isNull() | F.col("label_b").isNull(), "unlabelled").when(F.coalesce("conversation_a", F.lit("")) != F.coalesce("conversation_b", F.lit("")), "mismatch").otherwise("both")
    return both.withColumn("state", state).drop("in_a", "in_b")


def alignment_counts(both: DataFrame) -> DataFrame:
    states = ("both", "only_a", "only_b", "unlabelled", "mismatch")
    return both.agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])


def kappa_of(n: Column, observed: Column, expected: Column) -> Column:
    """Null without items or where chance agreement is certain."""
    return F.when((n > 0) & (expected != 1.0), (observed - expected) / (1.0 - expected))


def binary_kappa_of(observed: Column, expected: Column) -> Column:
    """The variant that is 1 or 0 where chance agreement is certain."""
    return F.when(expected == 1.0, F.when(observed == 1.0, 1.0).otherwise(0.0)).otherwise((observed - expected) / (1.0 - expected))


def kappa(pairs: DataFrame, a: str = "label_a", b: str = "label_b") -> DataFrame:
    """n, observed and expected agreement, κ over all labels. Only the table of label counts is looked at after one pass."""
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    total = cells.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    rows, cols = cells.groupBy("a").agg(F.sum("c").alias("ra")), cells.groupBy("b").agg(F.sum("c").alias("cb"))
    chance = rows.join(cols, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("ra") * F.col("cb")), F.lit(0)).alias("x"))
    out = total.crossJoin(chance)  # single rows
    n = F.col("n")
    po, pe = F.try_divide("same", n), F.try_divide("x", n * n)
    return out.select("n", po.alias("observed"), pe.alias("expected"), kappa_of(n, po, pe).alias("kappa"))


def kappa_by(pairs: DataFrame, by: list[str], a: str = "label_a", b: str = "label_b") -> DataFrame:
    """`kappa` for each group: from the label counts of a group, of which there are labels x labels."""
    cells = pairs.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    total = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    rows, cols = cells.groupBy(*by, F.col("a").alias("l")).agg(F.sum("c").alias("ra")), cells.groupBy(*by, F.col("b").alias("l")).agg(F.sum("c").alias("cb"))
    chance = rows.join(cols, [*by, "l"]).groupBy(*by).agg(F.sum(F.col("ra") * F.col("cb")).alias("x"))
    n = F.col("n")
    po, pe = F.col("same") / n, F.coalesce("x", F.lit(0)) / (n * n)
    return total.join(chance, by, "left").select(*by, "n", po.alias("observed"), pe.alias("expected"), kappa_of(n, po, pe).alias("kappa"))


def annotator_pairs(sheets: DataFrame) -> DataFrame:
    """Items that two annotators both labelled, for every two of them. `sheets` has item_id, annotator_id, conversation_id, label; one
    row for each item and annotator, so an item has no more rows than there are annotators."""
    side = lambda s: sheets.filter("label is not null").select("item_id", *[F.col(c).alias(f"{c.split('_')[0]}_{s}") for c in ("annotator_id", "conversation_id", "label")])
    both = side("a").join(side("b"), "item_id").filter("annotator_a < annotator_b")
    return both.filter(F.coalesce("conversation_a", F.lit("")) == F.coalesce("conversation_b", F.lit("")))


def category_kappas_by(pairs: DataFrame, by: list[str], labels: tuple[str, ...] = LABELS, a: str = "label_a", b: str = "label_b") -> DataFrame:
    """`category_kappas` for each group."""
    counts = pairs.groupBy(*by).agg(F.count("*").alias("n"), *[x for k, l in enumerate(labels) for x in (F.count_if(F.col(a) == l).alias(f"a{k}"), F.count_if(F.col(b) == l).alias(f"b{k}"), F.count_if((F.col(a) == l) & (F.col(b) == l)).alias(f"ab{k}"))])
    long = counts.select(*by, "n", F.inline(F.array(*[F.struct(F.lit(l).alias("label"), F.col(f"a{k}").alias("n_a"), F.col(f"b{k}").alias("n_b"), F.col(f"ab{k}").alias("n_both")) for k, l in enumerate(labels)])))
    n, x, y, z = F.col("n"), F.col("n_a"), F.col("n_b"), F.col("n_both")
    return long.select(*by, "label", "n_a", "n_b", (x + y - z).alias("n_either"), "n_both", kappa_of(n, (n - x - y + 2 * z) / n, (x * y + (n - x) * (n - y)) / (n * n)).alias("kappa"))


def category_kappas(pairs: DataFrame, labels: tuple[str, ...] = LABELS, a: str = "label_a", b: str = "label_b") -> DataFrame:
    """One against the rest: label, n_a, n_b, n_either, n_both, κ; one pass of conditional counts."""
    counts = pairs.agg(F.count("*").alias("n"), *[x for k, l in enumerate(labels) for x in (F.count_if(F.col(a) == l).alias(f"a{k}"), F.count_if(F.col(b) == l).alias(f"b{k}"), F.count_if((F.col(a) == l) & (F.col(b) == l)).alias(f"ab{k}"))])
    long = counts.select("n", F.inline(F.array(*[F.struct(F.lit(l).alias("label"), F.col(f"a{k}").alias("n_a"), F.col(f"b{k}").alias("n_b"), F.col(f"ab{k}").alias("n_both")) for k, l in enumerate(labels)])))
    n, x, y, z = F.col("n"), F.col("n_a"), F.col("n_b"), F.col("n_both")
    po = F.try_divide(n - x - y + 2 * z, n)
    pe = F.try_divide(x * y + (n - x) * (n - y), n * n)
    return long.select("label", "n_a", "n_b", (x + y - z).alias("n_either"), "n_both", kappa_of(n, po, pe).alias("kappa"))


def meets(c: Column, threshold: float = KAPPA_THRESHOLD) -> Column:
    return c >= F.lit(threshold - TOLERANCE)


def confusion(pairs: DataFrame, labels: tuple[str, ...] = LABELS, a: str = "label_a", b: str = "label_b") -> DataFrame:
    """(label_a, label_b, n) for every pair of labels, zeros included."""
    one = pairs.agg(*[F.count_if((F.col(a) == x) & (F.col(b) == y)).alias(f"c{i}_{j}") for i, x in enumerate(labels) for j, y in enumerate(labels)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("label_a"), F.lit(y).alias("label_b"), F.col(f"c{i}_{j}").alias("n")) for i, x in enumerate(labels) for j, y in enumerate(labels)])))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Interval of a share; (0, 1) without trials."""
    p = F.try_divide(k.cast("double"), n)
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (mid - half) / scale)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), (mid + half) / scale))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts, in logarithms; 1 without discordance."""
    n, k = (b + c).cast("double"), F.least(b, c)
    step = lambda s, j: F.struct((s["l"] + F.log((n - j) / (j + 1))).alias("l"), (s["t"] + F.exp(s["l"] + F.log((n - j) / (j + 1)))).alias("t"))
    start = F.struct((-n * math.log(2)).alias("l"), F.exp(-n * math.log(2)).alias("t"))
    tail = F.when(k == 0, F.exp(-n * math.log(2))).otherwise(F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.greatest(k.cast("bigint") - 1, F.lit(0).cast("bigint"))), start, step)["t"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def scored(items: DataFrame, predictions: DataFrame, key: str = "row", gold: str = "action") -> DataFrame:
    """(system, key, conversation_id, gold, predicted, correct) of items with a gold label."""
    g = items.filter(F.col(gold).isNotNull()).select(key, "conversation_id", F.col(gold).alias("gold"))
    return predictions.join(g, key).withColumn("correct", F.coalesce(F.col("predicted") == F.col("gold"), F.lit(False)))


def accuracy(rows: DataFrame) -> DataFrame:
    """Per system: n, correct, accuracy (0 if empty) and its Wilson interval."""
    per = rows.groupBy("system").agg(F.count("*").alias("n"), F.count_if("correct").alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return per.select("system", "n", F.col("k").alias("correct"), (F.col("k") / F.col("n")).alias("accuracy"), lo.alias("lo"), hi.alias("hi"))


def by_class(rows: DataFrame) -> DataFrame:
    return rows.groupBy("system", "gold").agg(F.count("*").alias("support"), F.count_if("correct").alias("correct")).withColumn("accuracy", F.col("correct") / F.col("support")).orderBy("system", F.desc("support"), "gold")


def compared(rows: DataFrame, a: str, b: str, key: str = "row") -> DataFrame:
    """Two systems over the same items: accuracies, difference in points, discordant counts, exact p. Unequal item sets raise."""
    side = lambda s, name: rows.filter(F.col("system") == s).select(key, F.col("correct").alias(name))
    both = side(a, "x").join(side(b, "y"), key, "full_outer")
    agg = both.agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unpaired"), F.count_if("x").alias("ka"), F.count_if("y").alias("kb"), F.count_if(F.col("x") & ~F.col("y")).alias("_nb"), F.count_if(~F.col("x") & F.col("y")).alias("_nc"))
    agg = agg.withColumn("n", F.when(F.col("unpaired") > 0, F.raise_error(F.lit("systems cover different items")).cast("bigint")).otherwise(F.col("n")))
    fa, fb = F.try_divide("ka", "n"), F.try_divide("kb", "n")
    return agg.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", fa.alias("accuracy_a"), fb.alias("accuracy_b"), (100 * (fa - fb)).alias("diff_pp"), F.col("_nb").alias("only_a"), F.col("_nc").alias("only_b"), mcnemar(F.col("_nb"), F.col("_nc")).alias("p"))


def holm(rows: DataFrame, p: str = "p", tie: str = "name") -> DataFrame:
    """Step-down adjusted p values; the rows are comparisons, few by nature."""
    m = F.count("*").over(W.partitionBy(F.lit(1)))
    rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(p, tie))
    held = rows.withColumn("_a", F.least(F.lit(1.0), (m - rank + 1) * F.col(p))).withColumn("_r", rank)
    return held.withColumn("p_holm", F.max("_a").over(W.partitionBy(F.lit(1)).orderBy("_r"))).drop("_a", "_r")


# -- resampling ------------------------------------------------------------------------------------------------------
GROUPS = 100_000


def _replicates(spark, stats: np.ndarray, times: np.ndarray, resamples: int, seed: int, value, tasks: int = 16):
    """(replicate, value): each replicate draws as many clusters as there are, with replacement.

    Clusters with equal statistics are interchangeable, so a replicate is one multinomial draw over the distinct statistics:
    its cost does not grow with the clusters.
    """
    total, probs = int(times.sum()), times / times.sum()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].to_numpy()
            out = [value(np.random.default_rng([seed, int(r)]).multinomial(total, probs) @ stats) for r in ids]
            yield pd.DataFrame({"replicate": ids, "value": out})

    return spark.range(0, resamples, 1, tasks).mapInPandas(draw, "replicate bigint, value double")


def bootstrap_accuracy(rows: DataFrame, *, resamples: int = 10_000, seed: int = 0, cluster: str = "conversation_id") -> DataFrame:
    """Cluster bootstrap of one system's accuracy: lo and hi by index (floor of 2.5 %, ceiling of 97.5 %), and the width in points."""
    per = rows.groupBy(F.coalesce(F.col(cluster), F.concat(F.lit("row:"), F.col("row").cast("string"))).alias("c")).agg(F.count("*").alias("n"), F.count_if("correct").alias("k"))
    held = lookup_rows(per.groupBy("n", "k").agg(F.count("*").alias("times")).orderBy("n", "k"), GROUPS)
    if not held:
        return rows.sparkSession.createDataFrame([], "n_clusters bigint, accuracy double, lo double, hi double, width_pp double")
    stats, times = np.array([[r.n, r.k] for r in held], float), np.array([r.times for r in held], float)
    reps = _replicates(rows.sparkSession, stats, times, resamples, seed, lambda s: s[1] / s[0])
    lo, hi = int(0.025 * (resamples - 1)), math.ceil(0.975 * (resamples - 1))
    one = reps.agg(F.array_sort(F.collect_list("value")).alias("v"))  # as many numbers as resamples
    whole = times @ stats
    return one.select(F.lit(int(times.sum())).cast("bigint").alias("n_clusters"), F.lit(float(whole[1] / whole[0])).alias("accuracy"), F.col("v")[lo].alias("lo"), F.col("v")[hi].alias("hi"), ((F.col("v")[hi] - F.col("v")[lo]) * 100).alias("width_pp"))


def kappa_of_cells(cells: np.ndarray, size: int) -> float:
    t = cells.reshape(size, size)
    n = t.sum()
    if n == 0:
        return math.nan
    pe = float(t.sum(axis=1) @ t.sum(axis=0)) / (n * n)
    return math.nan if pe == 1 else (np.trace(t) / n - pe) / (1 - pe)


def bootstrap_kappa(pairs: DataFrame, labels: tuple[str, ...] = LABELS, *, unit: str | None = "conversation_a", resamples: int = 2_000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """κ with a percentile interval (linear interpolation); replicates without κ are left out and counted."""
    size = len(labels)
    code = lambda c: sum((F.when(F.col(c) == l, k).otherwise(0) for k, l in enumerate(labels)), F.lit(0))
    cells = pairs.withColumn("_cell", code("label_a") * size + code("label_b"))
    by = F.coalesce(F.col(unit), F.lit("")) if unit else F.col("item_id")
    per = cells.groupBy(by.alias("c"), "_cell").agg(F.count("*").alias("n")).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("_cell", "n"))).alias("s"))
    held = lookup_rows(per.groupBy("s").agg(F.count("*").alias("times")).orderBy(F.col("s").cast("string")), GROUPS)
    stats = np.zeros((len(held), size * size))
    for i, r in enumerate(held):
        for x in r.s:
            stats[i, x["_cell"]] = x["n"]
    times = np.array([r.times for r in held], float)
    if not held:
        return pairs.sparkSession.createDataFrame([], "n_units bigint, kappa double, lo double, hi double, undefined bigint, interpretable boolean")
    reps = _replicates(pairs.sparkSession, stats, times, resamples, seed, lambda s: kappa_of_cells(s, size))
    fine = F.when(~F.isnan("value"), F.col("value"))
    tail = (1 - level) / 2
    point = kappa_of_cells(times @ stats, size)
    return reps.agg(F.percentile(fine, F.lit(tail)).alias("lo"), F.percentile(fine, F.lit(1 - tail)).alias("hi"), F.count_if(F.isnan("value")).alias("undefined")).select(
        F.lit(int(times.sum())).cast("bigint").alias("n_units"), F.lit(None if math.isnan(point) else float(point)).cast("double").alias("kappa"), "lo", "hi", "undefined", (F.col("undefined") / resamples <= MAX_UNDEFINED).alias("interpretable")
    )


# -- ranks -----------------------------------------------------------------------------------------------------------
def average_ranks(rows: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Ranks from 1 with ties averaged, from the counts of distinct values."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn(name, before + (F.col("_c") + 1) / 2).drop("_c")
    return rows.join(ranks, [*by, value])


def wilcoxon_less(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Signed-rank test that x is less than y: n, W+, normal-approximation p (with tie correction); (0, 1) if all are equal."""
    d = rows.withColumn("_d", F.col(x) - F.col(y)).filter("_d <> 0").withColumn("_m", F.abs("_d"))
    ranked = average_ranks(d, "_m", by, "_r")
    ties = d.groupBy(*by, "_m").agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    w = ranked.groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w"))
    keys = rows.select(*by).distinct()
    held = keys.join(w.join(ties, by), by, "left")
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48
    z = (F.col("w") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt(var)
    spark_p = normal_cdf(z)
    return held.select(*by, F.coalesce("n", F.lit(0.0)).cast("bigint").alias("n"), F.coalesce("w", F.lit(0.0)).alias("w_plus"), F.when(F.col("n").isNull(), 1.0).otherwise(spark_p).alias("p"))


def _phi(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(-v / math.sqrt(2)))


_phi.__annotations__ = {"z": pd.Series, "return": pd.Series}


def normal_cdf(z: Column) -> Column:
    return F.pandas_udf(_phi, "double")(z)


def spearman(points: list[tuple[float, float]]) -> tuple[float, float]:
    """ρ and its two-sided p of at least three points (a report row, not a table)."""
    n = len(points)
    if n < 3:
        raise ValueError("at least three points are needed")

    def ranks(v: np.ndarray) -> np.ndarray:
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    a, b = ranks(np.array([p[0] for p in points], float)), ranks(np.array([p[1] for p in points], float))
    rho = float(np.corrcoef(a, b)[0, 1])
    if abs(rho) >= 1 - 1e-12:
        return rho, 0.0
    t = abs(rho) * math.sqrt((n - 2) / (1 - rho * rho))
    return rho, 2 * _t_tail(t, n - 2)


def _t_tail(t: float, df: int) -> float:
    """Upper tail of Student's t by Simpson's rule on the angle (exact to about 1e-12)."""
    a = math.atan(t / math.sqrt(df))
    xs = np.linspace(a, math.pi / 2, 20_001)
    y = np.cos(xs) ** (df - 1)
    h = (math.pi / 2 - a) / 20_000
    area = h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    whole = math.sqrt(math.pi) * math.gamma(df / 2) / math.gamma((df + 1) / 2)
    return float(area / whole)


def disagreements(both: DataFrame) -> DataFrame:
    """Items on which the sheets differ: by label, or by value where both say VALUE."""
    same = strict_key(F.coalesce("value_a", F.lit(""))) == strict_key(F.coalesce("value_b", F.lit("")))
    kind = F.when(F.col("label_a") != F.col("label_b"), "label").when((F.col("label_a") == "VALUE") & ~same, "value")
    return both.filter("state = 'both'").withColumn("kind", kind).filter("kind is not null").select("item_id", "kind", "label_a", "label_b", "value_a", "value_b")


def value_agreement(both: DataFrame) -> DataFrame:
    """Over items both call VALUE: n, strict and number-aware agreement (null without items)."""
    rows = both.filter("state = 'both' and label_a = 'VALUE' and label_b = 'VALUE'")
    a, b = F.coalesce("value_a", F.lit("")), F.coalesce("value_b", F.lit(""))
    return rows.agg(F.count("*").alias("n"), F.avg((strict_key(a) == strict_key(b)).cast("double")).alias("strict"), F.avg((number_key(a) == number_key(b)).cast("double")).alias("number_aware"))


def agreement_report(both: DataFrame, source: str | None = None) -> DataFrame:
    """Per source subset and combined: n, percent agreement, κ."""
    pairs = both.filter("state = 'both'")
    out = kappa(pairs).withColumn("subset", F.lit("combined"))
    if not source:
        return out
    return out.unionByName(kappa_by(pairs.filter(F.col(source).isNotNull()).withColumn("subset", F.col(source)), ["subset"]))

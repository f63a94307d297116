"""Gates: conditions over aggregates, each with a verdict, and the verdict of all.

A verdict is PASS, FAIL or NOT_ESTABLISHED; FAIL outweighs NOT_ESTABLISHED outweighs PASS. Inputs are single rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BANDS = {"slot": (60.0, 70.0), "intent": (66.0, 76.0)}
EFFECT_PP, ALPHA, CLEAR_RATE, RHO, P_RANK, TOLERANCE = 10.0, 0.05, 50.0, -0.9, 0.01, 1e-9


def verdict(established: Column, passes: Column) -> Column:
    return F.when(~F.coalesce(established, F.lit(False)) | passes.isNull(), "NOT_ESTABLISHED").when(passes, "PASS").otherwise("FAIL")


def conditions(row: DataFrame, parts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(condition, verdict) rows from one aggregate row; parts: name -> (established, passes)."""
    held = F.array(*[F.struct(F.lit(n).alias("condition"), verdict(e, p).alias("verdict")) for n, (e, p) in parts.items()])
    return row.select(F.inline(held))


def overall(rows: DataFrame) -> DataFrame:
    rank = F.when(F.col("verdict") == "FAIL", 2).when(F.col("verdict") == "NOT_ESTABLISHED", 1).otherwise(0)
    worst = F.coalesce(F.max(rank), F.lit(1))
    return rows.agg(F.when(worst == 2, "FAIL").when(worst == 1, "NOT_ESTABLISHED").otherwise("PASS").alias("verdict"))


def band_gate(rates: DataFrame, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """(kind, rate, passes) for exact-name rates of kinds with an inclusive band."""
    inside = reduce(lambda acc, kv: F.when(F.col("kind") == kv[0], F.col("rate").between(*kv[1])).otherwise(acc), bands.items(), F.lit(None).cast("boolean"))
    return rates.filter(F.col("kind").isin(*bands)).select("kind", "rate", inside.alias("passes"))


def clear_gate(flags: DataFrame, threshold: float = CLEAR_RATE) -> DataFrame:
    """Rate of rows that clear under every model: (n, rate, passes). `flags` has key, model, clears."""
    per = flags.groupBy("key").agg(F.bool_and("clears").alias("all"))
    return per.agg(F.count("*").alias("n"), F.avg(F.col("all").cast("double") * 100).alias("rate")).withColumn("passes", F.col("rate") >= threshold - TOLERANCE)


def rank_gate(tests: DataFrame) -> DataFrame:
    """Passes if under every model p is below P_RANK and rho at most RHO."""
    return tests.agg(F.bool_and((F.col("p") < P_RANK) & (F.col("rho") <= RHO + TOLERANCE)).alias("passes"))


def effect_gate(row: DataFrame) -> DataFrame:
    """A difference of at least EFFECT_PP points with p below ALPHA."""
    return row.withColumn("passes", (F.col("diff_pp") >= EFFECT_PP - TOLERANCE) & (F.col("p") < ALPHA))


def two_part_gate(compared: DataFrame | None, best_accuracy: float | None, ceiling: float | None, spark=None) -> DataFrame:
    """(condition, verdict) and the gate: does the task need the better system (`compared`: one row with diff_pp and p, none if nothing
    was compared), and is there headroom of EFFECT_PP points between its accuracy and the ceiling. What is not known is NOT_ESTABLISHED."""
    known = lambda v: F.lit(v).cast("double")
    spark = spark or compared.sparkSession
    one = spark.range(1) if compared is None else compared.limit(1)
    passes = F.lit(None).cast("boolean") if compared is None else (F.col("diff_pp") >= EFFECT_PP) & (F.col("p") < ALPHA)
    rows = conditions(one, {"needed": (F.lit(compared is not None), passes), "headroom": (F.lit(best_accuracy is not None and ceiling is not None), (known(ceiling) - known(best_accuracy)) * 100 >= EFFECT_PP)})
    return rows.unionByName(overall(rows).select(F.lit("gate").alias("condition"), "verdict"))


def constraint_check(failures: DataFrame, constrained: str, free: str) -> DataFrame:
    """Verdict on the constrained system from `failures` (system, failures): FAIL if any answer failed; else PASS, but NOT_ESTABLISHED
    if the free system never failed either, or there is no constrained one."""
    n = lambda s: F.max(F.when(F.col("system") == s, F.col("failures")))
    return failures.agg(n(constrained).alias("_c"), n(free).alias("_f")).select(F.when(F.col("_c").isNull(), "NOT_ESTABLISHED").when(F.col("_c") > 0, "FAIL").when(F.col("_f") == 0, "NOT_ESTABLISHED").otherwise("PASS").alias("verdict"))


def model_agreement(near: DataFrame) -> DataFrame:
    """(model, n, clear_rate, top1, kappa): per model the rate of rows that clear, in percent; per pair of models, named a|b, how often
    they have the same nearest, and κ of their decisions. `near` has key, model, nearest, clears; one row for each key and model."""
    from talkmill.operators.stats import kappa_of

    alone = near.groupBy("model").agg(F.count("*").alias("n"), (F.avg(F.col("clears").cast("double")) * 100).alias("clear_rate"))
    side = lambda s: near.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("model", "nearest", "clears")])
    both = side("a").join(side("b"), "key").filter("model_a < model_b")  # a few models
    one = lambda c: F.count_if(c)
    per = both.groupBy(F.concat_ws("|", "model_a", "model_b").alias("model")).agg(
        F.count("*").alias("n"), (F.avg((F.col("nearest_a") == F.col("nearest_b")).cast("double")) * 100).alias("top1"), one(F.col("clears_a") == F.col("clears_b")).alias("_same"), one(F.col("clears_a")).alias("_a"), one(F.col("clears_b")).alias("_b")
    )
    n = F.col("n")
    expected = (F.col("_a") * F.col("_b") + (n - F.col("_a")) * (n - F.col("_b"))) / (n * n)
    pairs = per.select("model", "n", F.lit(None).cast("double").alias("clear_rate"), "top1", kappa_of(n, F.col("_same") / n, expected).alias("kappa"))
    return alone.withColumn("top1", F.lit(None).cast("double")).withColumn("kappa", F.lit(None).cast("double")).unionByName(pairs)


def seed_gate(rows: DataFrame) -> DataFrame:
    """Per primary seed's verdict, UNSTABLE if seeds disagree, NOT_ESTABLISHED without it. `rows` has seed, is_primary, passes."""
    return rows.agg(F.when(~F.coalesce(F.bool_or("is_primary"), F.lit(False)), "NOT_ESTABLISHED").when(F.bool_and("passes") != F.bool_or("passes"), "UNSTABLE").when(F.bool_or(F.col("is_primary") & F.col("passes")), "PASS").otherwise("FAIL").alias("verdict"))


def agreement_gate(kappas: DataFrame, types: tuple[str, ...], threshold: float, least: int) -> DataFrame:
    """(label, verdict): MEETS or BELOW the threshold, NOT_INTERPRETABLE below `least` items of either rater or without κ."""
    return kappas.filter(F.col("label").isin(*types)).select("label", F.when((F.col("n_either") < least) | F.col("kappa").isNull(), "NOT_INTERPRETABLE").when(F.col("kappa") >= threshold - TOLERANCE, "MEETS").otherwise("BELOW").alias("verdict"))


def _text_places(path: str, kind: T.DataType, allowed: set[str]) -> list[str]:
    if path in allowed:
        return []
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _text_places(f"{path}.{f.name}", f.dataType, allowed)]
    if isinstance(kind, T.ArrayType):
        return _text_places(path, kind.elementType, allowed)
    if isinstance(kind, T.MapType):
        return _text_places(f"{path}.key", kind.keyType, allowed) + _text_places(f"{path}.value", kind.valueType, allowed)
    return [] if isinstance(kind, (T.NumericType, T.BooleanType, T.NullType)) else [path]


def safe_output(df: DataFrame, allowed: set[str]) -> DataFrame:
    """Refuse a report that may hold text outside of the list: free text never leaves by way of a report.

    Nested values are walked; a place is named by its path (`a.b`), and a listed path allows all below it.
    """
    bad = [p for f in df.schema.fields for p in _text_places(f.name, f.dataType, allowed)]
    if bad:
        raise ValueError(f"columns may hold text: {bad}")
    return df

"""Simple predictors, cost accounts, loss masks and sweep selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.functions.text import normal_label


def majority(items: DataFrame, label: str = "action") -> DataFrame:
    """One row: the most frequent label, the largest among ties, and its count."""
    counts = items.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", label))
    return counts.agg(best.alias("b")).select(F.col(f"b.{label}").alias("label"), F.col("b.n").alias("n"))


def predict_majority(train: DataFrame, items: DataFrame, key: str = "row", label: str = "action") -> DataFrame:
    return items.select(key).crossJoin(F.broadcast(majority(train, label))).select(F.lit("majority").alias("system"), key, F.col("label").alias("predicted"))  # a single row


def parse_failures(predictions: DataFrame, vocabulary: DataFrame, label: str = "action") -> DataFrame:
    """Per system, predictions outside the vocabulary."""
    known = vocabulary.select(normal_label(label).alias("k")).filter("k is not null").distinct().withColumn("_hit", F.lit(1))
    return predictions.withColumn("k", normal_label("predicted")).join(known, "k", "left").groupBy("system").agg(F.count("*").alias("n"), F.count_if(F.col("_hit").isNull()).alias("failures"))


def floor_of(accuracies: DataFrame) -> DataFrame:
    """The best system, the largest name among ties."""
    return accuracies.agg(F.max(F.struct("accuracy", "system")).alias("b")).select("b.system", "b.accuracy")


def spread(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, least, most and sample standard deviation (0 for one value)."""
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"))


def costs(calls: DataFrame, *, input_price: float, output_price: float) -> DataFrame:
    """Per system: tokens, cost in units per million tokens, and means per item."""
    n = F.greatest(F.lit(1), F.count("*"))
    cost = F.sum("tokens_in") / 1e6 * input_price + F.sum("tokens_out") / 1e6 * output_price
    return calls.groupBy("system").agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), cost.alias("cost"), (cost / n).alias("cost_per_item"), (F.sum("latency_ms") / n).alias("latency_ms"))


def masked(prompt: Column, completion: Column) -> Column:
    """inputs = all but the last token, targets = all but the first, weights = 1 where the target is of the completion.

    Raises for an empty prompt or completion; the three arrays are of one length and the weights sum to the completion's.
    """
    full, p, c = F.concat(prompt, completion), F.size(prompt), F.size(completion)
    fine = (p > 0) & (c > 0)
    weights = F.concat(F.array_repeat(F.lit(0.0), p - 1), F.array_repeat(F.lit(1.0), c))
    made = F.struct(F.slice(full, F.lit(1), p + c - 1).alias("inputs"), F.slice(full, F.lit(2), p + c - 1).alias("targets"), weights.alias("weights"))
    return F.when(fine, made).otherwise(F.raise_error(F.lit("prompt and completion must hold tokens")).cast("struct<inputs:array<int>,targets:array<int>,weights:array<double>>"))


def mask_totals(rows: DataFrame, weights: str = "weights") -> DataFrame:
    w = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return rows.agg(F.count("*").alias("n"), F.sum(w).alias("weighted"), F.sum(F.size(weights)).alias("positions"), F.try_divide(F.sum(w), F.sum(F.size(weights))).alias("share"), F.avg(w).alias("mean_weighted"))


def token_ids(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ids): white-space tokens numbered by their first appearance in key order."""
    from talkmill.common import numbered

    each = rows.select(key, F.posexplode(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")).alias("pos", "token"))
    first = each.groupBy("token").agg(F.min(F.struct(key, "pos")).alias("o")).select("token", F.col(f"o.{key}").alias("o1"), F.col("o.pos").alias("o2")).withColumn("_all", F.lit("a"))
    ids = numbered(first, "_all", ["o1", "o2"], "id").select("token", "id")
    return each.join(ids, "token").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"].cast("int")).alias("ids"))


def best_epochs(runs: DataFrame, patience: int = 2) -> DataFrame:
    """(lr, seed, epoch, accuracy): the first best epoch of each run, where a run ends after `patience` epochs without strict gain."""
    w = W.partitionBy("lr", "seed").orderBy("epoch")
    before = F.max("accuracy").over(w.rowsBetween(W.unboundedPreceding, -1))
    gain = runs.withColumn("_gain", before.isNull() | (F.col("accuracy") > before))
    last = F.max(F.when(F.col("_gain"), F.col("epoch"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    stopped = F.max((F.col("_since") >= patience).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    live = gain.withColumn("_since", F.col("epoch") - last).withColumn("_stop", F.coalesce(stopped, F.lit(0))).filter("_stop = 0")
    best = live.groupBy("lr", "seed").agg(F.max(F.struct("accuracy", (-F.col("epoch")).alias("e"))).alias("b"))
    return best.select("lr", "seed", (-F.col("b.e")).alias("epoch"), F.col("b.accuracy").alias("accuracy"))


def selected_rate(best: DataFrame) -> DataFrame:
    """The learning rate of the best mean accuracy over seeds, the lower among ties."""
    per = best.groupBy("lr").agg(F.avg("accuracy").alias("mean"), F.count("*").alias("seeds"))
    return per.agg(F.max(F.struct("mean", (-F.col("lr")).alias("l"))).alias("b")).select((-F.col("b.l")).alias("lr"), F.col("b.mean").alias("mean"))


def text_classifier(train: DataFrame, *, text: str = "user_message", label: str = "action", reg: float = 0.01, features: int = 1 << 14):
    """TF-IDF of one and two words (raw counts of hashed grams, vectors of length one) and a multinomial logistic regression; a single class raises."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer

    rows = train.filter(F.col(label).isNotNull()).select(F.coalesce(text, F.lit("")).alias("_text"), F.col(label).alias("_label"))
    if rows.select("_label").distinct().limit(2).count() < 2:
        raise ValueError("one class only")
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_one", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False, minTokenLength=1), NGram(n=2, inputCol="_one", outputCol="_two"),
        SQLTransformer(statement="SELECT *, concat(_one, _two) AS _grams FROM __THIS__"), HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features"),
        StringIndexer(inputCol="_label", outputCol="label", handleInvalid="keep"), LogisticRegression(maxIter=100, regParam=reg, family="multinomial"),
    ]
    return Pipeline(stages=stages).fit(rows)

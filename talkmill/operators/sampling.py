"""Deterministic sampling: rows are ordered by the SHA-256 of a seed and their key.

The same seed gives the same result however rows are laid out, in any engine. A sample of n rows is a top-n by hash
(each task keeps n rows); nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUOTAS = {"correction": 0.2, "field_mention": 0.4, "hedge": 0.2}
RANDOM_SHARE = 0.2


def hash_key(seed: str | int, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]), 256)


def bucket(h: Column, n: int) -> Column:
    """A hash as a number below n: its first eight hex digits."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % n


def sample(rows: DataFrame, n: int, seed: str | int, key: str) -> DataFrame:
    """n rows by hash order (all if fewer)."""
    return rows.withColumn("_h", hash_key(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def quota_sample(candidates: DataFrame, n: int, seed: str | int, *, key: str = "turn_id", strata: str = "strata", quotas: dict[str, float] = QUOTAS, wholesale: tuple[str, ...] = ()) -> DataFrame:
    """(key, stratum) of a sample of n over overlapping strata.

    Wholesale strata are taken first and whole; then the others in name order, each up to its share of n of what is not yet
    chosen; the rest at random. A row chosen for one stratum is not chosen again. Targets round half to even.
    """
    from talkmill.common import written

    pool = written(candidates.select(key, strata).distinct())  # every stratum reads it
    chosen = None
    left = n
    order = [s for s in sorted(quotas) if s in wholesale] + [s for s in sorted(quotas) if s not in wholesale]
    for s in order:
        free = pool.filter(F.array_contains(strata, s))
        if chosen is not None:
            free = free.join(chosen.select(key), key, "left_anti")
        target = round(quotas[s] * n)
        part = free.select(key) if s in wholesale else sample(free.select(key), min(target, max(left, 0)), f"{seed}:{s}", key)
        left -= target
        part = written(part.withColumn("stratum", F.lit(s)))
        chosen = part if chosen is None else chosen.unionByName(part)
    rest = pool.join(chosen.select(key), key, "left_anti") if chosen is not None else pool
    fill = sample(rest.select(key), max(left, 0), f"{seed}:random", key).withColumn("stratum", F.lit("random"))
    return fill if chosen is None else chosen.unionByName(fill)


def shortfall(chosen: DataFrame, n: int, quotas: dict[str, float] = QUOTAS) -> DataFrame:
    """(stratum, target, got, missing)."""
    spark = chosen.sparkSession
    rows = [(s, round(q * n)) for s, q in sorted(quotas.items())]
    rows.append(("random", n - sum(t for _, t in rows)))
    t = spark.createDataFrame(rows, "stratum string, target int")
    got = chosen.groupBy("stratum").agg(F.count("*").alias("got"))
    return F.broadcast(t).join(got, "stratum", "left").select("stratum", "target", F.coalesce("got", F.lit(0)).alias("got"), F.greatest(F.lit(0), F.col("target") - F.coalesce("got", F.lit(0))).alias("missing"))


def aliases(rows: DataFrame, key: str, seed: str | int, prefix: str = "c") -> DataFrame:
    """(key, alias): prefix and three or more digits in hash order. Numbering runs over range-partitioned rows."""
    from talkmill.common import numbered

    ids = rows.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_all", F.lit("a")).withColumn("_h", hash_key(f"alias:{seed}", key))
    return numbered(ids, "_all", ["_h", key], "_k").select(key, F.format_string(f"{prefix}%03d", F.col("_k").cast("bigint") + 1).alias("alias"))


def numbered_conversations(rows: DataFrame, key: str) -> DataFrame:
    """(key, name): conv_001 and on, in order of the key."""
    from talkmill.common import numbered

    ids = rows.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_all", F.lit("a"))
    return numbered(ids, "_all", [key], "_k").select(key, F.format_string("conv_%03d", F.col("_k").cast("bigint") + 1).alias("name"))


def batches(rows: DataFrame, key: str, seed: str | int, size: int = 8) -> DataFrame:
    """(key, batch, place): a seeded shuffle cut into batches."""
    from talkmill.common import numbered

    held = rows.select(key).withColumn("_all", F.lit("a")).withColumn("_h", hash_key(seed, key))
    n = numbered(held, "_all", ["_h", key], "_k")
    return n.select(key, F.floor(F.col("_k") / size).cast("bigint").alias("batch"), (F.col("_k") % size).cast("bigint").alias("place"))


def annotator_orders(blocks: DataFrame, names: list[str], seed: str | int, *, key: str = "key", tries: int = 8) -> DataFrame:
    """(annotator, key, place): each annotator's own order of the blocks; the attempt is raised while two orders are equal.

    Orders are compared by the hash of their sequence of keys, of which only one value per annotator reaches the driver.
    """
    from talkmill.common import numbered

    spark = blocks.sparkSession
    for attempt in range(tries):
        who = spark.createDataFrame([(x,) for x in names], "annotator string")
        rows = blocks.select(key).distinct().crossJoin(F.broadcast(who))  # a few annotators
        held = numbered(rows.withColumn("_h", hash_key(seed, "annotator", F.lit(attempt), key)), "annotator", ["_h", key], "place")
        marks = held.groupBy("annotator").agg(F.sum(F.xxhash64("place", key).cast("decimal(38,0)")).alias("m")).collect()
        if len({r.m for r in marks}) == len(marks):
            break
    return held.select("annotator", key, F.col("place").cast("bigint").alias("place"))


def orders_report(orders: DataFrame, *, key: str = "key") -> DataFrame:
    """One row: how many annotators there are and whether their orders are all distinct (with one block or too many annotators they cannot be)."""
    marks = orders.groupBy("annotator").agg(F.sum(F.xxhash64("place", key).cast("decimal(38,0)")).alias("m"))
    return marks.agg(F.count("*").alias("annotators"), (F.count_distinct("m") == F.count("*")).alias("orders_distinct"))


def few_shot(items: DataFrame, k: int, seed: str | int, *, key: str = "row", label: str = "action") -> DataFrame:
    """Up to k examples: one of each class in class order, then at random, in a seeded order of their own: (key, label, place)."""
    rows = items.filter(F.col(label).isNotNull()).select(key, label).withColumn("_h", hash_key(seed, key))
    first = rows.groupBy(label).agg(F.min(F.struct("_h", key)).alias("x")).select(label, F.col(f"x.{key}").alias(key), F.col("x._h").alias("_h")).orderBy(label).limit(k)
    rest = rows.join(F.broadcast(first.select(key)), key, "left_anti").orderBy("_h", key).limit(k)  # first has at most k rows
    both = first.withColumn("_o", F.lit(0)).select(key, label, "_o", F.col(label).alias("_s"), "_h").unionByName(rest.select(key, label, F.lit(1).alias("_o"), F.col("_h").alias("_s"), "_h"))
    kept = both.orderBy("_o", "_s", key).limit(k)
    return kept.withColumn("place", F.row_number().over(W.orderBy(hash_key(f"order:{seed}", key), key))).select(key, label, "place")  # at most k rows


def split_by_conversation(items: DataFrame, targets: dict[str, int], seed: str | int, rest: str = "train", *, conversation: str = "conversation_id") -> DataFrame:
    """(conversation, items, split): conversations in hash order fill each target in turn; one joins while the items before it are below the target.

    Running sums per split are over range-partitioned conversations, not in one task.
    """
    from talkmill.common import running, written

    left = written(items.filter(F.col(conversation).isNotNull()).groupBy(conversation).agg(F.count("*").alias("items")).withColumn("_h", hash_key(seed, conversation)).withColumn("_all", F.lit("a")))
    out = None
    for name, target in targets.items():
        cum = written(running(left, "_all", ["_h", conversation], F.col("items"), "_before"))
        part = cum.filter(F.col("_before") < target).select(conversation, "items", F.lit(name).alias("split"))
        out = part if out is None else out.unionByName(part)
        left = cum.filter(F.col("_before") >= target).drop("_before")
    return out.unionByName(left.select(conversation, "items", F.lit(rest).alias("split")))


def whole_turns(items: DataFrame, n_items: int, fields: int, *, turn: str = "turn_id") -> DataFrame:
    """Rows of the first n_items // fields turns, so that no turn is cut."""
    keep = items.select(turn).distinct().orderBy(turn).limit(n_items // fields)
    return items.join(keep, turn, "left_semi")

"""Splits that keep related records together.

Families: the connected components of conversations. Every contact ties its conversations to the smallest of them; these edges
are contracted by alternating large-star and small-star steps over an edge table. Every step is a minimum per node (combined
map-side) and a join, in which nodes of very high degree are joined apart. No component, list of neighbours or edge table comes
to the driver or into one task.

Assignment: grouped iterative stratification over the label vectors of families, whatever the number of labels. Families are
placed by the rarest outstanding label first, each into the split that needs that label most. Families over 1/LARGE of the rows
(so fewer than LARGE of them) are placed first, on the driver. The others are laid out by range of their rarest label, rarest
labels first, SHARD families or so to a partition: all families of a rare label lie side by side and are stratified as one,
those of a common label in runs, each against its share of what the large ones left open.

Defined results: ids are compared trimmed in upper case; rows without conversation id are families of their own; blank or
malformed contacts tie nothing; blank labels are the label ''; repeated rows count as often as they stand; ties go to the
smaller family name and to the earlier split.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.common import discard, join_hot, norm_id, table, trimmed, written

SHARES = {"train": 0.8, "dev": 0.1, "test": 0.1}
LARGE, SHARD = 1000, 20_000


def minima(edges: DataFrame) -> DataFrame:
    """u -> smallest of u and its neighbours, and its degree."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, family) for the nodes of `edges` (u, v): family is the smallest node of the component."""
    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(join_hot(both, minima(both), "u", "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        small = join_hot(large, minima(large), "u", "n")
        last, e = e, written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        discard(last, large)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == now:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("family")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("family")).distinct())


def contact(c: Column | str) -> Column:
    """CT and eight digits, case and outer blanks aside; anything else is null."""
    t = F.upper(trimmed(c))
    return F.when(t.rlike(r"^CT[0-9]{8}$"), t)


def split_name(c: Column | str) -> Column:
    t = F.lower(trimmed(c))
    return F.when(t.isin("val", "validation"), "dev").when(t != "", t)


def families(items: DataFrame, threads: DataFrame) -> DataFrame:
    """(conv, family) of conversations that share a contact with another; others are their own family and not listed."""
    ties = threads.select(norm_id("conversation_id").alias("conv"), contact("contact_id").alias("ct")).filter("conv is not null and ct is not null").distinct()
    low = ties.groupBy("ct").agg(F.min("conv").alias("v"), F.count("*").alias("n"))
    found = components(join_hot(ties, low, "ct", "n").select(F.col("conv").alias("u"), "v"))
    return found.select(F.col("node").alias("conv"), F.concat(F.lit("V:"), "family").alias("family"))


def with_family(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with `conv`, and their family. The join is by the distinct conversations, so that a large one isn't moved twice."""
    convs = rows.filter("conv is not null").groupBy("conv").agg(F.count("*").alias("n")).join(found, "conv", "left").select("conv", F.coalesce("family", F.concat(F.lit("V:"), "conv")).alias("family"), "n")
    return join_hot(rows.filter("conv is not null"), convs, "conv", "n")


def crossing(items: DataFrame, threads: DataFrame) -> DataFrame:
    """Conversations of items whose family carries more than one split among its items."""
    rows = items.select(norm_id("conversation_id").alias("conv"), split_name("split").alias("split")).filter("conv is not null")
    per = rows.groupBy("conv").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    fam = per.join(families(items, threads), "conv", "left").withColumn("family", F.coalesce("family", F.concat(F.lit("V:"), "conv")))
    fam = written(fam)
    bad = fam.groupBy("family").agg(F.min("lo").alias("l"), F.max("hi").alias("h"), F.count("*").alias("n")).filter("l <> h").select("family", "n")
    return join_hot(fam, bad, "family", "n").select(F.col("conv").alias("conversation_id"))


def place(families_: list[tuple[str, dict]], need: dict, splits: int) -> list[int]:
    """The split of each family (name, records by label). need: label -> what each split wants of it, changed in place.

    In turn: the label with the fewest records outstanding; of the families holding it, in falling order of how many they
    hold, each goes to the split that needs that label most, then needs most records, then comes first.
    """
    split = [-1] * len(families_)
    outstanding: dict = {}
    holders: dict = {}
    for k, (_, labels) in enumerate(families_):
        for x, n in labels.items():
            outstanding[x] = outstanding.get(x, 0) + n
            holders.setdefault(x, []).append(k)
    total = [sum(need[x][s] for x in outstanding) for s in range(splits)]
    heap = [(n, x) for x, n in outstanding.items()]
    heapq.heapify(heap)
    while heap:
        n, label = heapq.heappop(heap)
        if outstanding.get(label) != n:
            continue  # placed already, or another entry has its present number
        del outstanding[label]
        want = need[label]
        for k in sorted((k for k in holders[label] if split[k] < 0), key=lambda k: (-families_[k][1][label], families_[k][0])):
            best = max(range(splits), key=lambda s: (want[s], total[s], -s))
            split[k] = best
            for x, m in families_[k][1].items():
                need[x][best] -= m
                total[best] -= m
                if x in outstanding:
                    outstanding[x] -= m
                    heapq.heappush(heap, (outstanding[x], x))
    return split


def stratify(names: list, vectors: np.ndarray, need: np.ndarray) -> np.ndarray:
    """`place` for a matrix of families x labels; need: splits x labels, changed in place."""
    wants = {k: need[:, k].tolist() for k in range(vectors.shape[1])}
    out = place([(n, {k: v for k, v in enumerate(row) if v > 0}) for n, row in zip(names, vectors.tolist())], wants, len(need))
    for k, w in wants.items():
        need[:, k] = w
    return np.array(out, np.int64)


def label_vectors(rows: DataFrame) -> DataFrame:
    """(family, n, labels: array of label, n and the label's rows in all, rare: the fewest rows and name of a label). `rows` have family, label."""
    per = written(rows.groupBy("family", "label").agg(F.count("*").alias("n")))
    whole = per.groupBy("label").agg(F.sum("n").alias("whole"), F.count("*").alias("families"))
    each = join_hot(per, whole, "label", "families")
    return each.groupBy("family").agg(F.sum("n").alias("n"), F.collect_list(F.struct("label", "n", "whole")).alias("labels"), F.min(F.struct("whole", "label")).alias("rare"))


def assign(items: DataFrame, threads: DataFrame, *, key: str = "row_no", label: str = "action", shares: dict[str, float] = SHARES, shard: int = SHARD) -> DataFrame:
    """(key, family, split) for every row of items."""
    names, share = list(shares), np.array(list(shares.values()), float)
    share = (share / share.sum()).tolist()
    rows = items.select(F.col(key).alias("key"), norm_id("conversation_id").alias("conv"), F.coalesce(F.lower(trimmed(label)), F.lit("")).alias("label"))
    rows = rows.withColumn("conv", F.coalesce("conv", F.concat(F.lit("row:"), F.col("key").cast("string"), F.lit("?"))))
    rows = written(with_family(rows, families(items, threads)))
    fam = written(label_vectors(rows))
    sums = fam.agg(F.count("*").alias("families"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    is_large = F.col("n") * LARGE > int(sums["n"])
    large = fam.filter(is_large).collect()  # fewer than LARGE
    need = {x["label"]: [x["whole"] * s for s in share] for r in large for x in r["labels"]}
    placed = place([(r["family"], {x["label"]: x["n"] for x in r["labels"]}) for r in large], need, len(names))
    opened = {x: [max(w, 0) / t for w in want] if (t := sum(max(w, 0) for w in want)) else share for x, want in need.items()}  # each split's part of what is still to be placed

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(r["family"], {x["label"]: x["n"] for x in r["labels"]}, r["n"]) for b in batches for r in b.to_pylist()]
        here: dict = {}
        for _, labels, _ in found:
            for x, n in labels.items():
                here[x] = here.get(x, 0) + n
        split = place([f[:2] for f in found], {x: [n * w for w in opened.get(x, share)] for x, n in here.items()}, len(names))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([names[s] for s in split], pa.string()), pa.array([f[2] for f in found], pa.int64())], ["family", "split", "n"])

    shards = max(1, -(-int(sums["families"]) // shard))
    small = fam.filter(~is_large).repartitionByRange(shards, F.col("rare.whole"), F.col("rare.label"), F.xxhash64("family")).select("family", "labels", "n")
    out = small.mapInArrow(fill, "family string, split string, n bigint")
    if large:
        out = out.unionByName(items.sparkSession.createDataFrame([(r["family"], names[s], r["n"]) for r, s in zip(large, placed)], "family string, split string, n bigint"))
    return join_hot(rows.select("key", "family"), written(out), "family", "n").select(F.col("key").alias(key), "family", "split")


def p1_found(spark, sf_dir: str) -> DataFrame:
    return crossing(table(spark, sf_dir, "items"), table(spark, sf_dir, "threads"))


def p1_assigned(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "items"), table(spark, sf_dir, "threads"))

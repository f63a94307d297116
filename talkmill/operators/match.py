"""Overlap between two sets of names, texts or vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import NAME_FORMS, name_tokens

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096


def exact_flags(queries: DataFrame, reference: DataFrame, form: str, *, name: str = "name") -> DataFrame:
    """`queries` with `key` (its name in this form) and `matched`: whether a reference name has the same form.

    Null names match nothing; an empty form is a key like any other. The reference side is reduced to distinct keys first.
    """
    make = NAME_FORMS[form]
    keys = reference.select(make(name).alias("key")).filter("key is not null").distinct().withColumn("_hit", F.lit(True))
    return queries.withColumn("key", make(name)).join(keys, "key", "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def match_rates(queries: DataFrame, reference: DataFrame, *, kind: str = "kind", name: str = "name") -> DataFrame:
    """(kind, form, unit, n, hits, rate in percent) for every form and for instances and unique names."""
    out = None
    for form, make in NAME_FORMS.items():
        keys = reference.select(kind, make(name).alias("key")).filter("key is not null").distinct().withColumn("_hit", F.lit(1))
        flags = queries.withColumn("key", make(name)).join(keys, [kind, "key"], "left")
        per_name = flags.groupBy(kind, name).agg(F.count("*").alias("n"), F.max(F.coalesce("_hit", F.lit(0))).alias("hit"))
        rows = per_name.groupBy(kind).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("hit")).alias("hits"), F.count("*").alias("n_u"), F.sum("hit").alias("hits_u"))
        both = F.inline(F.array(F.struct(F.lit("instances").alias("unit"), F.col("n"), F.col("hits")), F.struct(F.lit("unique").alias("unit"), F.col("n_u").alias("n"), F.col("hits_u").cast("bigint").alias("hits"))))
        part = rows.select(kind, F.lit(form).alias("form"), both).withColumn("rate", F.col("hits") / F.col("n") * 100)
        out = part if out is None else out.unionByName(part)
    return out


def evidence(queries: DataFrame, reference: DataFrame, form: str, *, name: str = "name", owner: str = "owner") -> DataFrame:
    """Per query key: how many queries have it, and the sorted owners of the reference names it equals (empty if none)."""
    make = NAME_FORMS[form]
    held = reference.select(make(name).alias("key"), F.col(owner).alias("_o")).filter("key is not null").distinct().groupBy("key").agg(F.array_sort(F.collect_list("_o")).alias("owners"))
    return queries.select(make(name).alias("key")).filter("key is not null").groupBy("key").agg(F.count("*").alias("n")).join(held, "key", "left").withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))


def seen_owners(queries: DataFrame, reference: DataFrame, *, owner: str = "owner") -> DataFrame:
    """Owners of `queries`, and whether the reference has them."""
    known = reference.select(owner).distinct().withColumn("_hit", F.lit(True))
    return queries.select(owner).distinct().join(known, owner, "left").select(owner, F.coalesce("_hit", F.lit(False)).alias("seen"))


def shared_frequency(queries: DataFrame, reference: DataFrame, form: str, *, name: str = "name", owner: str = "owner") -> DataFrame:
    """Per shared key: instances and distinct owners among the queries, distinct owners in the reference. Most frequent first."""
    make = NAME_FORMS[form]
    q = queries.select(make(name).alias("key"), F.col(owner).alias("_o")).filter("key is not null").groupBy("key").agg(F.count("*").alias("instances"), F.count_distinct("_o").alias("query_owners"))
    r = reference.select(make(name).alias("key"), F.col(owner).alias("_o")).filter("key is not null").groupBy("key").agg(F.count_distinct("_o").alias("reference_owners"))
    return q.join(r, "key").orderBy(F.desc("instances"), "key")


def _token_blocks(names: DataFrame, blocks: int, salt: int) -> DataFrame:
    return names.withColumn("b", F.pmod(F.xxhash64("n", F.lit(salt)), F.lit(blocks)))


def nearest_by_tokens(queries: DataFrame, reference: DataFrame, *, name: str = "name", key: str | None = None) -> DataFrame:
    """(name, nearest, score): the reference name of highest token Jaccard, the first in order among ties; 0 and the first name without a shared token.

    With `key` the queries are rows of the reference and a row is not its own neighbour: a name is its own nearest only where
    a row of another key has it too.

    Work is over distinct names in blocks, as in `nearest_by_cosine`. A pair of blocks makes a list of places for every token
    of its candidates; the overlaps of a query with all of them are the counts over the lists of its tokens. Each query keeps
    its best of the block, so no pair of names is emitted.
    """
    q = queries.select(F.col(name).alias("n")).filter("n is not null").distinct().withColumn("t", F.array_distinct(name_tokens("n")))
    alone = F.count_distinct(key) < 2 if key else F.lit(False)
    r = reference.withColumn("n", F.col(name)).filter("n is not null").groupBy("n").agg(alone.alias("alone")).withColumn("t", F.array_distinct(name_tokens("n")))
    nq, nr = max(1, -(-q.count() // QUERY_BLOCK)), max(1, -(-r.count() // CANDIDATE_BLOCK))
    left = _token_blocks(q, nq, 1).select(F.col("b").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("cb"), "n", "t")
    right = _token_blocks(r, nr, 2).select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), F.col("b").alias("cb"), "n", "t", "alone")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        names, near, score = [], [], []
        if b.num_rows:
            b = b.combine_chunks().sort_by("n")
            sizes = np.diff(np.asarray(b["t"].chunk(0).offsets))
            tokens, rows = b["t"].chunk(0).flatten().to_pylist(), np.repeat(np.arange(b.num_rows), sizes)
            lists: dict[str, list[int]] = {}
            for t, k in zip(tokens, rows.tolist()):
                lists.setdefault(t, []).append(k)
            held = {t: np.array(x) for t, x in lists.items()}
            sorted_names = b["n"].to_pylist()
            own = {n: k for k, (n, x) in enumerate(zip(sorted_names, b["alone"].to_pylist())) if x}
            for n, ts in zip(a["n"].to_pylist(), a["t"].to_pylist()):
                met = [held[t] for t in ts if t in held]
                both = np.bincount(np.concatenate(met), minlength=len(sizes)) if met else np.zeros(len(sizes), np.int64)
                union = sizes + len(ts) - both
                s = np.divide(both, union, out=np.zeros(len(sizes)), where=union > 0)
                if n in own:
                    s[own[n]] = -1
                k = int(s.argmax())
                if s[k] >= 0:
                    names.append(n), near.append(sorted_names[k]), score.append(float(s[k]))
        return pa.table({"n": pa.array(names, pa.string()), "nearest": pa.array(near, pa.string()), "score": pa.array(score, pa.float64())})

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(best, "n string, nearest string, score double")
    top = found.groupBy("n").agg(F.min(F.struct((-F.col("score")).alias("s"), "nearest")).alias("b"))
    return q.select("n").join(top, "n", "left").select(F.col("n").alias(name), F.col("b.nearest").alias("nearest"), F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("score"))


def unit(v: Column) -> Column:
    """A vector at length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero; vectors of unequal size raise."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    out = F.when((size(a) == 0) | (size(b) == 0), 0.0).otherwise(dot / (size(a) * size(b)))
    return F.when(F.size(a) == F.size(b), out).otherwise(F.raise_error(F.lit("vectors of unequal size")).cast("double"))


def _matrix(a: pa.Array) -> np.ndarray:
    flat = np.asarray(a.flatten(), np.float64)
    m = flat.reshape(len(a), -1) if len(a) else np.zeros((0, 0))
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True)) if len(a) else np.zeros((0, 1))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def nearest_by_cosine(queries: DataFrame, candidates: DataFrame, *, key: str = "vec_id", vector: str = "embedding", keep: int = 1) -> DataFrame:
    """(key, nearest, cosine, rank): exact, by dense products of blocks; ties go to the smaller key; a row is not its own neighbour.

    Queries and candidates are cut into blocks of bounded size; each pair of blocks is one product, of which every query
    keeps its best `keep`, so that what is shuffled is queries x candidate blocks and no pair of rows is ever emitted.
    """
    q = queries.select(F.col(key).alias("k"), F.col(vector).alias("v")).filter("v is not null")
    c = candidates.select(F.col(key).alias("k"), F.col(vector).alias("v")).filter("v is not null")
    nq, nc = max(1, -(-q.count() // QUERY_BLOCK)), max(1, -(-c.count() // CANDIDATE_BLOCK))
    side = lambda d, n, s: d.withColumn("b", F.pmod(F.xxhash64("k", F.lit(s)), F.lit(n)))
    left = side(q, nq, 1).select(F.col("b").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"), "k", "v")
    right = side(c, nc, 2).select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), F.col("b").alias("cb"), "k", "v")

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        rows: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            qa, ca = np.asarray(a["k"]), np.asarray(b["k"])
            order = np.argsort(ca, kind="stable")
            ca = ca[order]
            s = _matrix(a["v"].combine_chunks()) @ _matrix(b["v"].combine_chunks())[order].T
            s = np.round(s, 12)
            s[qa[:, None] == ca[None, :]] = -np.inf
            for _ in range(min(keep, len(ca))):
                best = s.argmax(axis=1)
                at = np.arange(len(qa))
                fine = np.isfinite(s[at, best])
                rows[0].append(qa[fine]), rows[1].append(ca[best[fine]]), rows[2].append(s[at, best][fine])
                s[at, best] = -np.inf
        cat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table({"k": cat(rows[0], pa.int64()), "nearest": cat(rows[1], pa.int64()), "cosine": cat(rows[2], pa.float64())})

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(product, "k bigint, nearest bigint, cosine double")
    if keep == 1:  # combined map-side, so a query holds one row whatever the number of blocks
        one = found.groupBy("k").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "nearest")).alias("t"))
        return one.select(F.col("k").alias(key), F.col("t.nearest").alias("nearest"), (-F.col("t.c")).alias("cosine"), F.lit(1).alias("rank"))
    best = found.groupBy("k").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "nearest"))), 1, keep).alias("top"))
    return best.select(F.col("k").alias(key), F.posexplode("top").alias("rank", "t")).select(key, F.col("t.nearest").alias("nearest"), (-F.col("t.c")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def paired_by_position(originals: DataFrame, variants: DataFrame) -> DataFrame:
    """Originals and variants joined by (owner, position); both with name, owner, position, vector. Variants also have `variant`."""
    o = originals.select("owner", "position", F.col("name").alias("original"), F.col("vector").alias("_a"))
    v = variants.select("owner", "position", "variant", F.col("name").alias("renamed"), F.col("vector").alias("_b"))
    return o.join(v, ["owner", "position"]).withColumn("cosine", cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def pairing_problems(originals: DataFrame, variants: DataFrame) -> DataFrame:
    """What keeps the two from pairing one to one: (variant, owner, problem)."""
    o = originals.groupBy("owner").agg(F.count("*").alias("n"))
    kinds = variants.select("variant").distinct()
    want = o.crossJoin(F.broadcast(kinds))  # one row for each owner and variant; variants are few by nature
    got = variants.groupBy("owner", "variant").agg(F.count("*").alias("m"))
    both = want.join(got, ["owner", "variant"], "full_outer")
    problem = F.when(F.col("n").isNull(), "unknown owner").when(F.col("m").isNull(), "missing owner").when(F.col("n") != F.col("m"), "unequal counts")
    return both.select("variant", "owner", problem.alias("problem")).filter("problem is not null")

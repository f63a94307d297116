import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.operators import baselines as B
from talkmill.operators import gates as G
from talkmill.operators import sampling as A
from talkmill.operators import stats as S


def pairs(spark, cells):
    rows = [(f"i{k}", f"c{k % 7}", a, b) for k, (a, b) in enumerate(x for (a, b), n in cells.items() for x in [(a, b)] * n)]
    return spark.createDataFrame(rows, "item_id string, conversation_a string, label_a string, label_b string")


def test_kappa(spark):
    k = lambda cells: S.kappa(pairs(spark, cells)).first().kappa
    assert k({("VALUE", "VALUE"): 5, ("NO-OP", "NO-OP"): 5}) == 1.0
    assert abs(k({("VALUE", "VALUE"): 5, ("VALUE", "NO-OP"): 5, ("NO-OP", "VALUE"): 5, ("NO-OP", "NO-OP"): 5})) < 1e-12
    assert k({("VALUE", "VALUE"): 9}) is None and S.kappa(pairs(spark, {("VALUE", "VALUE"): 1}).limit(0)).first().kappa is None
    cat = {r.label: r for r in S.category_kappas(pairs(spark, {("HEDGED", "HEDGED"): 2, ("HEDGED", "NO-OP"): 1, ("NO-OP", "HEDGED"): 1, ("NO-OP", "NO-OP"): 14})).collect()}
    assert cat["HEDGED"].n_either == 4 and abs(cat["HEDGED"].kappa - 0.6) < 1e-12 and cat["VALUE"].kappa is None
    g = {r.label: r.verdict for r in G.agreement_gate(spark.createDataFrame([("a", 10, 0.5999999999999996), ("b", 9, 0.9), ("c", 50, 0.59), ("d", 50, None)], "label string, n_either int, kappa double"), ("a", "b", "c", "d"), 0.6, 10).collect()}
    assert g == {"a": "MEETS", "b": "NOT_INTERPRETABLE", "c": "BELOW", "d": "NOT_INTERPRETABLE"}
    edge = spark.range(1).select(S.binary_kappa_of(F.lit(1.0), F.lit(1.0)), S.binary_kappa_of(F.lit(0.5), F.lit(1.0)), S.binary_kappa_of(F.lit(0.8), F.lit(0.5))).first()
    assert tuple(edge) == (1.0, 0.0, pytest.approx(0.6))


def test_confusion_margins(spark):
    p = pairs(spark, {("VALUE", "NO-OP"): 3, ("HEDGED", "HEDGED"): 2})
    c = S.confusion(p).collect()
    assert len(c) == 36 and sum(r.n for r in c) == 5


def test_alignment(spark):
    sheet = "item_id string, conversation_id string, label string, value string"
    a = spark.createDataFrame([("1", "c", "VALUE", "5 lakh"), ("2", "c", None, None), ("3", "c", "NO-OP", None), ("5", "c", "NO-OP", None)], sheet)
    b = spark.createDataFrame([("1", "c", "VALUE", "500,000"), ("2", "c", "NO-OP", None), ("4", "c", "NO-OP", None), ("5", "d", "NO-OP", None)], sheet)
    both = S.aligned(a, b)
    assert tuple(S.alignment_counts(both).first()) == (1, 1, 1, 1, 1)
    assert tuple(S.value_agreement(both).first()) == (1, 0.0, 1.0) and [r.kind for r in S.disagreements(both).collect()] == ["value"]


def test_mcnemar_and_wilson(spark):
    grid = [(b, c) for b, c in product(range(0, 14), repeat=2)] + [(30, 10), (300, 250)]
    df = spark.createDataFrame(grid, "b long, c long")
    for r in df.select("b", "c", S.mcnemar(F.col("b"), F.col("c")).alias("p")).collect():
        n, k = r.b + r.c, min(r.b, r.c)
        want = min(1.0, 2 * sum(math.comb(n, j) for j in range(k + 1)) / 2**n) if n else 1.0
        assert r.p == pytest.approx(want, rel=1e-9)
    lo, hi = S.wilson(F.lit(8), F.lit(10))
    zlo, zhi = S.wilson(F.lit(0), F.lit(0))
    got = spark.range(1).select(lo, hi, zlo, zhi).first()
    assert got[0] == pytest.approx(0.49016, abs=1e-4) and got[1] == pytest.approx(0.94332, abs=1e-4) and got[2:] == (0.0, 1.0)


def test_ranks(spark):
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 9, 60).astype(float)
    y = rnd.integers(2, 12, 60).astype(float)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)] + [("same", 1.0, 1.0)] * 3, "g string, x double, y double")
    got = {r.g: r for r in S.wilcoxon_less(df, "x", "y", ["g"]).collect()}
    d = (x - y)[x != y]
    m = np.abs(d)
    ranks = np.array([(m < v).sum() + ((m == v).sum() + 1) / 2 for v in m])
    w, n = ranks[d > 0].sum(), len(d)
    ties = sum(t**3 - t for t in np.unique(m, return_counts=True)[1])
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert got["g"].w_plus == pytest.approx(w) and got["g"].p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=1e-9)
    assert (got["same"].n, got["same"].w_plus, got["same"].p) == (0, 0.0, 1.0)
    rho, p = S.spearman([(1, 5), (2, 4), (3, 3), (4, 1), (5, 2)])
    assert rho == pytest.approx(-0.9) and p == pytest.approx(0.0373860735, abs=1e-8)
    with pytest.raises(ValueError):
        S.spearman([(1, 2)])


def test_published_signed_rank_figures(spark):
    """Normal approximation: W+ 2653 and 2072 of 160 pairs."""
    z = lambda w: (w - 160 * 161 / 4) / math.sqrt(160 * 161 * 321 / 24)
    got = spark.range(1).select(S.normal_cdf(F.lit(z(2653))), S.normal_cdf(F.lit(z(2072)))).first()
    assert got[0] == pytest.approx(5.5294e-11, rel=1e-4) and got[1] == pytest.approx(4.9759e-14, rel=1e-4)


def test_bootstrap_against_plain_resampling(spark):
    rnd = np.random.default_rng(2)
    sizes = rnd.integers(1, 9, 60)
    rows = [(f"c{c}", int(c * 100 + k), bool(rnd.random() < (0.9 if c % 2 else 0.4))) for c, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "conversation_id string, row long, correct boolean")
    got = S.bootstrap_accuracy(df, resamples=3000).first()
    per = np.array([[sum(r[0] == f"c{c}" for r in rows), sum(r[2] for r in rows if r[0] == f"c{c}")] for c in range(60)], float)
    plain = []
    for _ in range(3000):
        s = per[rnd.integers(0, 60, 60)].sum(axis=0)
        plain.append(s[1] / s[0])
    assert got.lo == pytest.approx(np.quantile(plain, 0.025), abs=0.02) and got.hi == pytest.approx(np.quantile(plain, 0.975), abs=0.02)
    assert tuple(S.bootstrap_accuracy(df, resamples=3000).first()) == tuple(got)
    assert S.bootstrap_accuracy(df.limit(0)).count() == 0
    p = pairs(spark, {("VALUE", "VALUE"): 30, ("VALUE", "NO-OP"): 6, ("NO-OP", "NO-OP"): 40, ("NO-OP", "VALUE"): 5})
    wide, narrow = S.bootstrap_kappa(p, resamples=800).first(), S.bootstrap_kappa(p, unit=None, resamples=800).first()
    assert wide.lo < wide.kappa < wide.hi and wide.n_units == 7 and narrow.n_units == 81 and narrow.undefined == 0


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "name string, p double")
    assert [pytest.approx(r.p_holm) for r in S.holm(df).orderBy("name").collect()] == [0.04, 0.09, 0.09, 0.5]


def test_unpaired_systems_raise(spark):
    df = spark.createDataFrame([("x", 1, True), ("x", 2, False), ("y", 1, True)], "system string, row long, correct boolean")
    with pytest.raises(Exception, match="different items"):
        S.compared(df, "x", "y").collect()


def test_baselines(spark):
    items = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "row long, action string")
    assert tuple(B.majority(items).first()) == ("b", 1)
    acc = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.4)], "system string, accuracy double")
    assert B.floor_of(acc).first().system == "b"
    runs = spark.createDataFrame([(1.0, 0, e, a) for e, a in enumerate([0.1, 0.5, 0.5, 0.4, 0.9])] + [(2.0, 0, e, a) for e, a in enumerate([0.5, 0.2])], "lr double, seed int, epoch int, accuracy double")
    best = {r.lr: (r.epoch, r.accuracy) for r in B.best_epochs(runs).collect()}
    assert best == {1.0: (1, 0.5), 2.0: (0, 0.5)} and B.selected_rate(B.best_epochs(runs)).first().lr == 1.0
    m = spark.sql("select array(1,2,3) p, array(7,8) c").select(B.masked(F.col("p"), F.col("c")).alias("m")).first().m
    assert (m.inputs, m.targets, m.weights) == ([1, 2, 3, 7], [2, 3, 7, 8], [0.0, 0.0, 1.0, 1.0])
    with pytest.raises(Exception, match="must hold tokens"):
        spark.sql("select array(1) p, cast(array() as array<int>) c").select(B.masked(F.col("p"), F.col("c"))).collect()
    ids = B.token_ids(spark.createDataFrame([(1, "a b a"), (2, " c b "), (3, None)], "row long, t string"), "row", "t")
    assert {r.row: r.ids for r in ids.collect()} == {1: [0, 1, 0], 2: [2, 1]}


def test_gates(spark):
    rows = lambda *v: spark.createDataFrame([(f"c{k}", x) for k, x in enumerate(v)], "condition string, verdict string")
    assert [G.overall(rows(*v)).first()[0] for v in (("PASS", "PASS"), ("PASS", "NOT_ESTABLISHED"), ("NOT_ESTABLISHED", "FAIL"))] == ["PASS", "NOT_ESTABLISHED", "FAIL"]
    seeds = lambda *v: spark.createDataFrame([(k, k == 0, x) for k, x in enumerate(v)], "seed int, is_primary boolean, passes boolean")
    assert [G.seed_gate(seeds(*v)).first()[0] for v in ((True, True), (True, False), (False, False))] == ["PASS", "UNSTABLE", "FAIL"]
    with pytest.raises(ValueError):
        G.safe_output(rows("PASS"), {"verdict"})
    bands = spark.createDataFrame([("slot", 60.0), ("intent", 65.9)], "kind string, rate double")
    assert {r.kind: r.passes for r in G.band_gate(bands).collect()} == {"slot": True, "intent": False}
    assert G.rank_gate(spark.createDataFrame([(0.001, -0.9), (0.002, -0.8999999999999998)], "p double, rho double")).first().passes is True


def test_sampling(spark):
    df = spark.createDataFrame([(k, ["hedge"] if k < 5 else ["field_mention"] if k < 30 else ["plain"]) for k in range(200)], "turn_id long, strata array<string>")
    got = A.quota_sample(df, 50, "s")
    n = {r.stratum: r["count"] for r in got.groupBy("stratum").count().collect()}
    assert n == {"hedge": 5, "field_mention": 20, "random": 10} and got.select("turn_id").distinct().count() == 35
    assert sorted(r[0] for r in got.select("turn_id").collect()) == sorted(r[0] for r in A.quota_sample(df.repartition(5), 50, "s").select("turn_id").collect())
    assert {r.stratum: r.missing for r in A.shortfall(got, 50).collect()} == {"hedge": 5, "field_mention": 0, "random": 0, "correction": 10}
    items = spark.createDataFrame([(f"c{k % 40}",) for k in range(400)], "conversation_id string")
    split = {r.split: r["sum(items)"] for r in A.split_by_conversation(items, {"test": 100, "dev": 45}, "s").groupBy("split").sum("items").collect()}
    assert split == {"test": 100, "dev": 50, "train": 250}
    orders = A.annotator_orders(df.withColumnRenamed("turn_id", "key"), ["a", "b"], "s")
    assert orders.groupBy("annotator").count().filter("count = 200").count() == 2


def test_two_part_gate_and_constraint(spark):
    row = lambda d, p: spark.createDataFrame([(float(d), float(p))], "diff_pp double, p double")
    verdicts = lambda df: {r.condition: r.verdict for r in df.collect()}
    assert verdicts(G.two_part_gate(row(10, 0.04), 0.8, 0.95)) == {"needed": "PASS", "headroom": "PASS", "gate": "PASS"}
    assert verdicts(G.two_part_gate(row(9.9, 0.04), 0.8, 0.95)) == {"needed": "FAIL", "headroom": "PASS", "gate": "FAIL"}
    assert verdicts(G.two_part_gate(row(12, 0.05), 0.9, None)) == {"needed": "FAIL", "headroom": "NOT_ESTABLISHED", "gate": "FAIL"}
    assert verdicts(G.two_part_gate(row(12, 0.01), 0.9, 0.95)) == {"needed": "PASS", "headroom": "FAIL", "gate": "FAIL"}
    assert verdicts(G.two_part_gate(None, None, 0.95, spark)) == {"needed": "NOT_ESTABLISHED", "headroom": "NOT_ESTABLISHED", "gate": "NOT_ESTABLISHED"}
    check = lambda *rows: G.constraint_check(spark.createDataFrame(list(rows), "system string, failures long"), "strict", "free").first()[0]
    assert check(("strict", 0), ("free", 3)) == "PASS" and check(("strict", 1), ("free", 3)) == "FAIL" and check(("strict", 0), ("free", 0)) == "NOT_ESTABLISHED" and check(("free", 0)) == "NOT_ESTABLISHED" and check(("strict", 0)) == "PASS"
    seeds = spark.createDataFrame([(1, False, True), (2, False, False)], "seed int, is_primary boolean, passes boolean")
    assert G.seed_gate(seeds).first()[0] == "NOT_ESTABLISHED" == G.seed_gate(seeds.limit(0)).first()[0]


def test_reports_hold_no_text(spark):
    df = spark.createDataFrame([(1, [("a", 2)], {"k": "v"})], "n int, rows array<struct<name:string,m:int>>, notes map<string,string>")
    for allowed in ({"rows.name"}, {"notes"}, set()):
        with pytest.raises(ValueError):
            G.safe_output(df, allowed)
    assert G.safe_output(df, {"rows", "notes"}) is df and G.safe_output(df.select("n"), set()).columns == ["n"]


def test_agreement_of_pairs(spark):
    rows = [(f"i{k}", who, "c", lab) for k in range(20) for who, lab in (("x", "VALUE" if k % 2 else "NO-OP"), ("y", "VALUE" if k % 4 else "NO-OP"), ("z", None))] + [("i1", "w", "other", "VALUE"), ("lone", "x", "c", "VALUE")]
    p = S.annotator_pairs(spark.createDataFrame(rows, "item_id string, annotator_id string, conversation_id string, label string"))
    got = S.kappa_by(p, ["annotator_a", "annotator_b"]).collect()
    one = S.kappa(p).first()
    assert [(r.annotator_a, r.annotator_b, r.n) for r in got] == [("x", "y", 20)] and abs(got[0].kappa - one.kappa) < 1e-12
    cat = {r.label: r.kappa for r in S.category_kappas_by(p, ["annotator_a"]).collect()}
    assert cat == {r.label: r.kappa for r in S.category_kappas(p).collect()}

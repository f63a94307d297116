import random

import numpy as np

from talkmill.llm import splits


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    pairs = [(f"a{rnd.randrange(60):03d}", f"a{rnd.randrange(60):03d}") for _ in range(45)] + [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(70)] + [("h000", f"h{k:03d}") for k in range(1, 80)]
    got = {r.node: r.family for r in splits.components(spark.createDataFrame(pairs, "u string, v string")).collect()}
    want = {k: v for k, v in union_find(pairs).items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert got == want


def items(spark, rows):
    return spark.createDataFrame([(k, *r, "x", 1) for k, r in enumerate(rows)], "row_no long, conversation_id string, action string, split string, family string, n int")


def threads(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conversation_id string, contact_id string, family string")


def test_crossing(spark):
    i = items(spark, [("A", "x", "train"), (" a ", "y", "TRAIN"), ("B", None, "dev"), ("C", "x", "val"), ("D", "x", "test"), ("D", "x", "test"), ("E", "x", None), (None, "x", "dev"), ("", "x", "train"), ("F", "x", "train"), ("f", "", "validation"), ("G", "x", "odd")])
    t = threads(spark, [("a", "CT00000001"), ("X", "ct00000001 "), ("x", "CT00000002"), ("B", "CT00000002"), ("C", "N/A"), ("D", "N/A"), ("E", None), (None, "CT00000001"), ("G", "CT0000001")])
    assert sorted(r[0] for r in splits.crossing(i, t).collect()) == ["A", "B", "F"]
    assert splits.crossing(i.limit(0), t.limit(0)).count() == 0


def test_assign_keeps_families_and_shares(spark):
    rnd = random.Random(1)
    rows = [(f"C{rnd.randrange(300)}" if k % 9 else None, rnd.choice(["a", "b", "c", None, "rare"] if k % 40 == 0 else ["a", "b", "c"]), None) for k in range(3000)]
    rows += [("BIG", "a", None)] * 900 + rows[:50]
    t = threads(spark, [(f"C{rnd.randrange(300)}", f"CT{rnd.randrange(250):08d}") for _ in range(90)])
    i = items(spark, rows)
    got = splits.assign(i, t).toPandas()
    assert sorted(got.row_no) == list(range(len(rows)))
    assert got.groupby("family").split.nunique().max() == 1
    share = got.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["dev"] - 0.1) < 0.02 and abs(share["test"] - 0.1) < 0.02
    assert splits.assign(i.limit(0), t.limit(0)).count() == 0


def test_rarest_label_first():
    vectors = np.array([[1.0, 0], [0, 1], [0, 1], [0, 1], [0, 1]])
    need = np.outer([0.5, 0.5], vectors.sum(axis=0))
    split = splits.stratify(list("abcde"), vectors, need)
    assert split[0] == 0 and sorted(split[1:]) == [0, 0, 1, 1]


def test_label_shares_over_many_shards(spark):
    """Far more families than a shard holds, 90 labels of which many are rare: every label is spread by the shares."""
    rnd = random.Random(7)
    rows, labels = [], [f"l{k:02d}" for k in range(90)]
    for k in range(6000):
        for _ in range(rnd.randrange(1, 5)):
            rows.append((f"C{k}", labels[min(int(rnd.expovariate(0.09)), 89)], None))
    i = items(spark, rows)
    got = splits.assign(i, threads(spark, [(f"C{rnd.randrange(6000)}", f"CT{rnd.randrange(4000):08d}") for _ in range(1500)]), shard=500).toPandas()
    assert got.groupby("family").split.nunique().max() == 1 and len(got) == len(rows)
    got["label"] = [rows[k][1] for k in got.row_no]
    off = 0.0
    for _, g in got.groupby("label"):
        part = g.split.value_counts(normalize=True)
        off = max(off, *(abs(part.get(s, 0) - w) - 4 / len(g) for s, w in splits.SHARES.items()))
    print(f"largest deviation of a label's share beyond four rows: {off:.3f}")
    assert off < 0.05

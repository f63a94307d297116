import random
from datetime import datetime

import numpy as np

from talkmill.llm import consensus as K

SCHEMA = "annotation_id long, annotator_id string, item_id string, field_name string, turn_text string, label string, value string, labelled_at timestamp, ann int, code int, t string, features string"


def frame(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)
    return df.withColumn("labelled_at", df.labelled_at.cast("timestamp_ntz"))


def test_labels_and_latest(spark):
    d = lambda k: datetime(2025, 1, k)
    rows = [
        (1, "a", "i", "f", "t", "no op", None, d(1)), (2, "a", "i", "f", "t", "Value", "40 lakhs", d(3)), (3, "a", "i", "f", "t", "junk", None, d(5)), (4, "b", "i", "f", None, "ABSTAIN/Ambiguous", None, None), (4, "b", "i", "f", None, "ABSTAIN/Ambiguous", None, None),
        (5, None, "i", "f", "t", "VALUE", None, d(1)), (6, "b", None, "f", "t", "VALUE", None, d(1)), (7, "c", "i", None, "x" * 50_000, None, None, d(1)), (8, "d", "j", "f", "t", "hedged", "x", d(2)), (9, "d", "j", "f", "t", "NO-OP", "x", d(2)),
    ]
    got = {(r.item_id, r.annotator_id): (K.LABELS[r.code], r.value) for r in K.latest(frame(spark, rows)).collect()}
    assert got == {("i", "a"): ("VALUE", "40 lakhs"), ("i", "b"): ("ABSTAIN:ambiguous", None), ("j", "d"): ("NO-OP", "x")}
    out, who = K.consensus(frame(spark, rows))
    assert {r.item_id for r in out.collect()} == {"i", "j"} and {r.annotator_id for r in who.collect()} == {"a", "b", "d"}


def test_empty(spark):
    out, who = K.consensus(frame(spark, []))
    assert out.count() == 0 and who.count() == 0


def test_recovers_planted_labels(spark):
    rnd = random.Random(5)
    skill = {"g1": 0.95, "g2": 0.9, "b1": 0.25, "b2": 0.25, "b3": 0.25, "m": 0.7}
    rows, truth, k = [], {}, 0
    for i in range(500):
        y = rnd.choice([0, 0, 0, 1, 1, 5])
        truth[f"i{i}"] = K.LABELS[y]
        for a in rnd.sample(sorted(skill), 4):
            z = y if rnd.random() < skill[a] else (0 if a[0] == "b" else rnd.randrange(6))
            k += 1
            rows.append((k, a, f"i{i}", "f", f"word{y} about {rnd.randrange(9)}", K.LABELS[z], "55" if z == 1 else None, datetime(2025, 1, 1)))
    out, who = K.consensus(frame(spark, rows))
    got = {r.item_id: r.label for r in out.collect()}
    votes = {}
    for r in rows:
        votes.setdefault(r[2], []).append(r[5])
    right = np.mean([got[i] == truth[i] for i in truth])
    majority = np.mean([max(sorted(set(v)), key=v.count) == truth[i] for i, v in votes.items()])
    trust = {r.annotator_id: r.reliability for r in who.collect()}
    assert right > majority and right > 0.93
    assert trust["g1"] > trust["m"] > trust["b1"]

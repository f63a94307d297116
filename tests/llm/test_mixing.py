import os
import random

import pytest

from talkmill.llm import encoding
from talkmill.llm import mixing as K

pytestmark = pytest.mark.skipif(not os.path.exists(f"{encoding.TOKENIZERS}/{encoding.NAME}.tiktoken"), reason="no vocabulary files here")


def test_flow_takes_first_uses_first():
    used, total = K.route({"a": 10, "ab": 10}, {"a": ["a"], "ab": ["a", "b"]}, {"a": 2, "b": 3}, {"a": 10, "b": 10})
    assert abs(total - 20) < 1e-6 and abs(used["a", "a"] - 10) < 1e-6 and abs(used["ab", "b"] - 10) < 1e-6
    assert K.largest_total({"a": 10, "b": 100}, {"a": ["a"], "b": ["b"]}, {"a": 3, "b": 1}, {"a": 0.5, "b": 0.5}) == 60


def frames(spark, n=300):
    docs = [(k, f"{'word ' * (k % 9 + 1)} {k}", ["big", "mid", "tiny", "other", None][0 if k % 2 else 1 if k % 8 else 2 if k % 16 == 0 else 3], "x", 5) for k in range(n)]
    docs += [(1000, None, "big", "x", 5), (1001, "", "mid", "x", 5), (1002, "shared text here", "big", "x", 5), (1003, "shared text here", "tiny", "x", 5), (1004, "shared text here", "tiny", "x", 5), (1005, "lost", None, "x", 5)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, pattern string, place int"), spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    docs, targets = frames(spark)
    got = K.mix(docs, targets).toPandas()
    caps = {"big": 1, "mid": 2, "tiny": 4}
    assert (got.repeats <= got.source.map(caps)).all() and not got.duplicated(["doc_id", "source"]).any() and set(got.source) == set(caps)
    share = {r.source: r.share for r in K.shares(K.mix(docs, targets), targets).collect()}
    assert abs(share["big"] - 0.5) < 0.05 and abs(share["mid"] - 0.3) < 0.05 and abs(share["tiny"] - 0.2) < 0.05
    assert not {1000, 1001, 1004} & set(got.doc_id)


def test_empty(spark):
    docs, targets = frames(spark, 4)
    assert K.mix(docs.limit(0), targets).count() == 0 and K.mix(docs, targets.limit(0)).count() == 0
    assert K.shares(K.mix(docs.limit(0), targets), targets).count() == 3


def test_shares_are_reached(spark):
    """Six unequal sources, a third of the texts in several of them: every share within a text for each pattern, repeats within bounds."""
    rnd = random.Random(21)
    share = {"a": 0.3, "b": 0.25, "c": 0.2, "d": 0.15, "e": 0.07, "f": 0.03}
    most = {"a": 1, "b": 2, "c": 1, "d": 4, "e": 3, "f": 1}
    rows, k = [], 0
    for j in range(900):
        text = " ".join(rnd.choice(["lift", "park", "price", "visit", "north", "tile"]) for _ in range(rnd.randrange(2, 30))) + f" {j}"
        for s in {rnd.choice("aaabbcde f".replace(" ", "")) for _ in range(rnd.choice([1, 1, 2, 3]))}:
            rows.append((k, s, text))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([(s, share[s], most[s]) for s in share], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in K.shares(K.mix(docs, targets), targets).collect()}
    off = max(abs(got[s].share - share[s]) for s in share)
    print(f"largest deviation from a share: {off:.4f}")
    assert off < 0.01 and all(got[s].most_repeats <= most[s] for s in share)

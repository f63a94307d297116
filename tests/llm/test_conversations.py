import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from talkmill.llm import conversations as K


def brute(rows):
    """rows: (conv, speaker, side, filled, at) -> reasons."""
    convs = defaultdict(list)
    for c, *r in rows:
        convs[c].append(r)
    out = {}
    for c, rs in convs.items():
        sides = defaultdict(set)
        for sp, sd, _, _ in rs:
            if sp is not None and sd:
                sides[sp].add(sd)
        content, broken = [], False
        for sp, sd, filled, at in rs:
            if sd is None and sp is not None:
                x = sides[sp] & {"customer", "agent"} or sides[sp]
                sd = next(iter(x)) if len(x) == 1 else None
            if not filled or sd == "system":
                continue
            broken |= sd is None or at is None or sp is not None and {"customer", "agent"} <= sides[sp]
            content.append((sd, at))
        first = min((a for s, a in content if s == "customer" and a is not None), default=None)
        if not content:
            out[c] = "empty"
        elif broken:
            out[c] = "broken"
        elif first is None or not any(s == "agent" and a > first for s, a in content):
            out[c] = "no_reply"
    return out


def test_against_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for c in range(400):
        for _ in range(rnd.choice([1, 2, 2, 3, 4, 6])):
            sp = rnd.choice(["p", "q", "r", None])
            side = {"p": "customer", "q": "agent", "r": rnd.choice(["system", "customer"])}.get(sp) if rnd.random() < 0.75 else rnd.choice([None, None, "customer", "agent", "system"])
            rows.append((f"V{c}", sp, side, rnd.random() < 0.85, rnd.choice([None, *range(1, 6)] if rnd.random() < 0.1 else range(1, 6))))
    rows += [("HOT", "p", "customer", True, k) for k in range(3000)] + [("HOT", "q", "agent", True, 1)]
    df = spark.createDataFrame(rows, "conv string, speaker string, side string, filled boolean, at long").repartition(7)
    got = {r[0]: r[1] for r in K.dropped(df).collect()}
    assert got == brute(rows) and "HOT" not in got


def test_automaton_composes():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        signs = rnd.integers(0, 3, rnd.integers(1, 9))
        run = np.sort(rnd.integers(0, 3, len(signs)))
        maps = K.compose_runs(run, K.NEXT[signs])
        for m, r in zip(maps, np.unique(run)):
            for s in range(5):
                want = s
                for x in signs[run == r]:
                    want = K.NEXT[x][want]
                assert m[s] == want


SCHEMA = "message_id long, source_conversation_id string, speaker string, timestamp_raw string, text string, role string, source_file string, source_row int, conv string, at string"


def tables(spark):
    roles = spark.createDataFrame([("Customer", "customer"), ("desk", "agent"), ("notice", "system"), (None, "agent")], "word string, side string")
    files = spark.createDataFrame([("f", "Asia/Kolkata", "DMY")], "source_file string, zone_name string, date_order string")
    words = spark.createDataFrame([("IST", 330)], "abbreviation string, offset_minutes int")
    return roles, files, words


def test_messages(spark):
    t = lambda m: f"2025-01-01 10:{m:02d}:00"
    rows = [
        (1, " a", "X", t(2), "thanks", "CUSTOMER "), (2, "A ", "Y", t(3), "here it is", "desk"), (3, "A", "Y", t(1), "[media: image]", "desk"), (4, "A", "Y", t(4), "again", None), (5, "A", "S", "??", "joined", "notice"),
        (6, "B", "X", t(1), "hello", "customer"), (7, "B", "Y", t(1), "same minute", "desk"), (8, "C", "X", t(1), "  ", "customer"), (9, "C", None, t(1), None, None), (10, "D", "X", "??", "when", "customer"),
        (11, None, "X", t(1), "lost", "customer"), (12, "E", None, t(1), "who", None), (13, "F", "Z", t(1), "one", "customer"), (14, "F", "Z", t(2), "two", "desk"), (15, "G", "X", t(1), "x" * 100_000, "customer"), (15, "G", "X", t(1), "x" * 100_000, "customer"), (16, "G", "Y", t(2), "ok", "desk"), (17, "", "X", t(1), "blank id", "customer"),
    ]
    df = spark.createDataFrame([(*r, "f", r[0], "clash", "clash") for r in rows], SCHEMA)
    r = K.sided(df, *tables(spark), keep=("message_id", "source_row", "text"))
    assert {x[0]: x[1] for x in K.dropped(r).collect()} == {"B": "no_reply", "C": "empty", "D": "broken", "E": "broken", "F": "broken"}
    turns = K.rebuild(r).filter("source_conversation_id = 'A'").orderBy(F.col("turn").asc_nulls_last()).collect()
    assert [(x.turn, x.role, x.message_id) for x in turns] == [(0, "customer", 1), (1, "agent", 2), (2, "agent", 4), (None, "system", 5)]
    empty = K.sided(df.limit(0), *[x.limit(0) for x in tables(spark)], keep=("message_id", "source_row", "text"))
    assert K.dropped(empty).count() == 0 and K.rebuild(empty).count() == 0

import random
from statistics import median

from pyspark.sql import functions as F

from talkmill.operators import match as M
from talkmill.operators import profile as P
from talkmill.plans import registry


def test_percentile_block(spark):
    rnd = random.Random(2)
    for n in (0, 1, 2, 5, 15, 40):
        v = sorted(rnd.randrange(30) for _ in range(n))
        got = P.percentile_block(spark.createDataFrame([(x,) for x in v], "k long"), "k").first()
        if not n:
            assert tuple(got) == (0, 0.0, 0.0, 0, 0, 0)
        else:
            assert tuple(got) == (n, sum(v) / n, float(median(v)), v[max(0, min(n, round(0.9 * n)) - 1)], v[-1], v[0])


def test_context_lengths(spark):
    rows = [(1, "a", "c", 2, "xx", None), (2, "b", "c", 1, "yyy", "zz"), (3, "d", "c", None, "w", "r"), (4, "e", None, 1, "q", "r")]
    items = spark.createDataFrame(rows, "row long, item_id string, conversation_id string, turn_index int, user_message string, reply string")
    assert {r.row: r.context_chars for r in P.context_lengths(items).collect()} == {2: 3, 1: 7, 3: 8}


def test_nearest_by_tokens_against_brute_force(spark):
    rnd = random.Random(3)
    name = lambda: " ".join(rnd.choice(["red", "blue", "old", "big", "gear", "bolt"]) for _ in range(rnd.randrange(0, 4)))
    q, r = [name() for _ in range(60)], [name() for _ in range(200)]
    got = {x.name: (x.nearest, x.score) for x in M.nearest_by_tokens(spark.createDataFrame([(x,) for x in q], "name string"), spark.createDataFrame([(x,) for x in r], "name string")).collect()}

    def score(a, b):
        a, b = set(a.split()), set(b.split())
        return len(a & b) / len(a | b) if a | b else 0.0

    for x in set(q):
        best = max(score(x, y) for y in r)
        assert got[x] == (min(y for y in r if score(x, y) == best), best)
    assert M.nearest_by_tokens(spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([], "name string")).first().nearest is None


def test_cosine(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0]), (6, None)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.nearest for r in M.nearest_by_cosine(df, df).collect()}
    assert got == {1: 5, 5: 1, 2: 1, 3: 2, 4: 1}
    two = M.nearest_by_cosine(df.filter("vec_id = 3"), df, keep=2).orderBy("rank").collect()
    assert [(r.nearest, r.rank) for r in two] == [(2, 1), (1, 2)]
    assert df.filter("vec_id = 4").select(M.unit(F.col("embedding"))).first()[0] == [0.0, 0.0]


def test_queries_and_sql_have_the_same_names():
    assert set(registry.oracles()) <= set(registry.queries())
    assert len(registry.queries()) > 80


def test_field_words_are_counted(spark):
    df = spark.createDataFrame([("customer", "need a 3BHK flat near work"), ("customer", "a flat for 80 lakhs please"), ("agent", "this flat is near you"), ("customer", "platform is the flattest one")], "role string, text string")
    got = {(r.section, r.name): r.n for r in P.field_word_frequencies(df).collect()}
    assert got["property_type", "bhk"] == 1 and got["property_type", "flat"] == 2 and got["location_preference", "near"] == 1 and got["budget", "lakhs"] == 1
    assert got["budget", "loan"] == 0 and got["pattern", "amount"] == 1 and got["pattern", "locality_suffix"] == 0
    assert len(got) == sum(map(len, P.FIELD_WORDS.values())) + 2 and "ag16_words" in registry.queries()


def test_reply_lengths(spark):
    got = {r.unit: tuple(r)[1:] for r in P.reply_lengths(spark.createDataFrame([("ab cd",), ("x",), (None,)], "reply string")).collect()}
    assert got == {"chars": (2, 3.0, 3.0, 5, 5, 1), "words": (2, 1.5, 1.5, 2, 2, 1)} and "ag5_lengths" in registry.queries()


def test_windows_over_cut_groups(spark):
    """One group of half the rows, cut into many parts: the rows before each are those of the whole group."""
    from pyspark.sql import Window as W

    from talkmill.common import with_earlier

    rnd = random.Random(6)
    rows = [("hot" if k % 2 else rnd.choice("abc") if k % 6 else None, rnd.randrange(50), k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, id int")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = with_earlier(df, "g", ["o", "id"], 3)
        w = W.partitionBy("g", "_part").orderBy("o", "id").rowsBetween(-3, -1)
        got = {r.id: r.x for r in laid.withColumn("x", F.collect_list("id").over(w)).filter(~F.col("_ghost")).collect()}
        most = laid.filter("g = 'hot' and not _ghost").groupBy("_part").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 400 and most < 60
    for g in ("hot", "a", "b", "c"):
        ids = [k for _, k in sorted((o, k) for x, o, k in rows if x == g)]
        assert all(got[k] == ids[max(0, j - 3) : j] for j, k in enumerate(ids))

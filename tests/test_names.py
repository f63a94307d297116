from talkmill.plans import names


def parts(spark, tmp_path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_token_queries_meet_each_other(spark, tmp_path):
    rows = [(0, "red gear", "B", "x", 1), (20, "red gear", "B", "x", 2), (40, "old bolt", "C", "y", 3), (60, "old bolt", "C", "y", 3), (1, "red rod", "D", "z", 4), (80, "", "", "", None)]
    got = {r.name: (r.nearest, r.score) for r in names.jn12_tokens(spark, parts(spark, tmp_path, rows)).collect()}
    assert got["red gear x B 1"] == ("red gear x B 2", 4 / 6)
    assert got["red gear x B 2"] == ("red gear x B 1", 4 / 6)
    assert got["old bolt y C 3"] == ("old bolt y C 3", 1.0)


def test_a_single_part_has_no_neighbour(spark, tmp_path):
    got = names.jn12_tokens(spark, parts(spark, tmp_path, [(0, "red gear", "B", "x", 1)])).collect()
    assert [tuple(r) for r in got] == [("red gear x B 1", None, 0.0)]


def test_every_part_has_name_forms(spark, tmp_path):
    rows = [(k, f"red gear{k}", "B", "x", 1) for k in range(6)]
    assert sorted(r.k for r in names.fn1_names(spark, parts(spark, tmp_path, rows)).collect()) == list(range(6))


def test_every_odd_part_is_a_reference(spark, tmp_path):
    rows = [(0, "red gear", "B", "x", 1), (1, "red gear", "B", "x", 1), (2, "old bolt", "B", "y", 2), (5, "old bolt", "B", "z", 2), (3, "new rod", "B", "z", 3)]
    at = parts(spark, tmp_path, rows)
    got = {(r.kind, r.form, r.unit): (r.n, r.hits) for r in names.QUERIES["jn1_rates"](spark, at).collect()}
    assert got["slot", "N0", "instances"] == (2, 2) and got["intent", "N2", "unique"] == (2, 1)
    assert {r.kind: (r.rate, r.passes) for r in names.gt1_bands(spark, at).collect()} == {"slot": (100.0, False), "intent": (50.0, False)}

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from talkmill.operators import extract as E
from talkmill.sources import readers as R
from talkmill.sources import writers as W
from talkmill.streaming import rejects as ST


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿conv_id,body,extra\nc1,"two\nlines, ""q""",x\nc2,,y\n', encoding="utf-8")
    df = R.read_csv(spark, str(p))
    m = R.ColumnMap({"conversation": "Conv_ID", "text": "body"}, required=("conversation", "text"), optional=("role",))
    got = R.with_row_numbers(m.apply(df)).orderBy("source_row").collect()
    assert [(r.conversation, r.text, r.role, r.source_row) for r in got] == [("c1", 'two\nlines, "q"', None, 0), ("c2", None, None, 1)]
    assert R.delimiter_for("x.tsv") == "\t" and R.delimiter_for("x.csv", ";") == ";"
    with pytest.raises(ValueError):
        R.delimiter_for("x", ";;")
    for bad in ({"conversation": "a"}, {"conversation": "a", "text": "b", "odd": "c"}):
        with pytest.raises(ValueError):
            R.ColumnMap(bad, required=("conversation", "text"))
    with pytest.raises(ValueError):
        R.ColumnMap({"text": "Body"}, required=("text",), excluded=("body",))
    with pytest.raises(ValueError):
        R.ColumnMap({"text": "absent"}, required=("text",)).check(["body"])


def test_json_and_maps(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"meta": 1, "rows": [{"a": 1, "b": None}, {"a": "x"}]}))
    assert [tuple(r) for r in R.read_json_rows(spark, str(tmp_path / "a.json"), ["a", "b"]).collect()] == [(0, "1", None), (1, "x", None)]
    (tmp_path / "m.json").write_text('{"i1": "train", "i2": "odd"}')
    assert R.read_map(spark, str(tmp_path / "m.json")).count() == 2
    with pytest.raises(Exception, match="not allowed"):
        R.read_map(spark, str(tmp_path / "m.json"), ("train",)).collect()
    (tmp_path / "ids.json").write_text('[{"id": "a"}, {"item_id": "b"}, {"item_id": "b"}]')
    assert sorted(r[0] for r in R.read_ids(spark, str(tmp_path / "ids.json")).collect()) == ["a", "b"]
    (tmp_path / "ids2.json").write_text('{"ids": ["x", "y"]}')
    assert sorted(r[0] for r in R.read_ids(spark, str(tmp_path / "ids2.json")).collect()) == ["x", "y"]
    (tmp_path / "s.json").write_text(json.dumps([{"service_name": "s", "slots": [{"name": "a", "description": "d", "is_categorical": True}, {"name": "b"}], "intents": [{"name": "i"}]}]))
    slots, intents = R.read_services(spark, str(tmp_path / "s.json"))
    assert [tuple(r) for r in slots.orderBy("position").collect()] == [("s", "a", "d", True, 0), ("s", "b", "", False, 1)] and tuple(intents.first()) == ("s", "i", "", 0)


def test_xlsx_and_discovery(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>conv</t></si><si><t>body</t></si><si><r><t>he</t></r><r><t>llo</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="s"><v>2</v></c></row><row/><row><c r="B4" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    got = R.read_xlsx(spark, str(tmp_path / "b.xlsx"), ["conv", "body"]).collect()
    assert [(r.source_row, r.conv, r.body) for r in got] == [(0, "7", "hello"), (1, None, "x")]
    (tmp_path / "sub").mkdir()
    for n in ("sub/c.csv", "~$d.csv", "e.meta.json", "f.txt"):
        (tmp_path / n).write_text("x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in R.discover(spark, str(tmp_path)).collect()) == ["b.xlsx", "c.csv"]


def test_sheets(spark):
    cols = "item_id string, conversation_id string, turn_index int, field_name string, label string, value string"
    good = spark.createDataFrame([(" i ", "c", 1, "f", "A", " ")], cols)
    assert tuple(R.read_sheet(good, ("A",)).first()) == ("i", "c", "1", "f", "A", None)
    for row in [("", "c", 1, "f", "A", "")], [("i", "c", 1, "f", "B", "")], [("i", "c", 1, "f", "A", ""), ("i", "c", 1, "f", "A", "")]:
        with pytest.raises(ValueError):
            R.read_sheet(spark.createDataFrame(row, cols), ("A",))


def test_writers(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("b", 2, "x"), ("a", 1, 'q"t')], "conversation_id string, k int, text string")
    W.write_csv(df, f"{root}/out.csv", root, ["conversation_id", "k"])
    assert [r.conversation_id for r in spark.read.option("header", True).csv(f"{root}/out.csv").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="(?i)exist"):
        W.write_csv(df, f"{root}/out.csv", root, ["k"])
    with pytest.raises(ValueError):
        W.write_csv(df, "/elsewhere/x", root, ["k"])
    with pytest.raises(ValueError):
        W.apart(root, f"{root}/in")
    W.write_conversations(df, f"{root}/conv", root)
    assert spark.read.json(f"{root}/conv").count() == 2
    W.write_document({"b": 1, "a": None}, f"{root}/d/m.json", root)
    assert json.loads((tmp_path / "d/m.json").read_text()) == {"a": None, "b": 1}
    W.write_audit(df, f"{root}/audit", root)
    assert spark.read.json(f"{root}/audit").groupBy("record").count().count() == 2
    W.write_sheets(df.withColumn("annotator", F.lit("z")).withColumn("item_id", F.col("k")).withColumn("secret", F.lit("s")), f"{root}/sheets", root)
    assert "secret" not in spark.read.option("header", True).csv(f"{root}/sheets").columns
    items = spark.createDataFrame([(k, f"i{k}", "m", "a" if k % 2 else None) for k in range(20)], "row long, item_id string, user_message string, action string")
    blind, key = W.recheck(items, 4, "s")
    assert blind.count() == 4 and {r.action for r in blind.collect()} == {""} and sorted(r.item_id for r in blind.collect()) == sorted(r.item_id for r in key.collect())
    with pytest.raises(Exception, match="not written out"):
        W.write_scored(spark.createDataFrame([("i", "test")], "item_id string, split string"), f"{root}/sc", root)


def test_extract(spark):
    assert E.looks_conversational("chat_log", []) and E.looks_conversational("t", ["body", "sent_at", "sender"]) and not E.looks_conversational("invoices", ["id", "number"])
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    split = spark.createDataFrame([("a", "dev")], "item_id string, split string")
    assert E.attach(items.filter("item_id = 'a'"), split, "item_id", "split").first().split == "dev"
    with pytest.raises(Exception, match="no split"):
        E.attach(items, split, "item_id", "split").collect()
    with pytest.raises(ValueError):
        E.must_be_empty(E.unclassified(items, "item_id", ("a",)), "unknown kinds")
    assert E.ordered_union([items, items.withColumn("x", F.lit(1))], ["item_id"]).count() == 4


def test_streams(spark, tmp_path):
    lines = spark.createDataFrame([(1, "f", "i,C,1,hello,go,r,l"), (2, "f", "bad")], "line_id long, source_file string, raw_line string")
    lines.write.parquet(str(tmp_path / "in"))
    files = spark.createDataFrame([("f", ",")], "source_file string, field_sep string")
    acts = spark.createDataFrame([("go",)], "action_name string")
    out = ST.stream_records(ST.stream_table(spark, str(tmp_path / "in"), "line_id long, source_file string, raw_line string"), files, acts)
    q = out.writeStream.format("memory").queryName("records").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert {r.line_id: r.reason for r in spark.table("records").collect()} == {1: None, 2: "column_count"}
    ev = spark.createDataFrame([("c", "2025-01-01T10:05:00Z", "UTC", "DMY"), ("c", "2025-01-01T10:50:00Z", "UTC", "DMY"), ("c", "junk", "UTC", "DMY")], "conv string, raw string, zone string, ord string")
    hours = ST.messages_per_hour(ST.stream_instants(ev, {}, raw="raw", zone="zone", order="ord"), "conv").collect()
    assert [r.n for r in hours] == [2]

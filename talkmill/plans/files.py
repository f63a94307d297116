"""Readers and writers over whole tables: each query writes a table in a form, reads it back, and gives what came back."""

import uuid

from pyspark.sql import functions as F

from talkmill.common import checkpoint_dir, table
from talkmill.functions.text import blank_to_null
from talkmill.operators import stats as S
from talkmill.plans.fragments import blank
from talkmill.sources import readers as R
from talkmill.sources import writers as K

_ITEMS = ("row_no", "item_id", "conversation_id", "turn_index", "user_message", "action", "reply", "labeler", "split")


def _at(spark) -> tuple[str, str]:
    """A new place in the shared folder, and that folder."""
    root = checkpoint_dir(spark).removeprefix("file://").removeprefix("file:")
    return f"{root}/files-{uuid.uuid4().hex}", root


def _items_csv(spark, sf_dir) -> str:
    path, root = _at(spark)
    K.write_csv(table(spark, sf_dir, "items").select(*_ITEMS), path, root, ["row_no"], single=False)
    return path


def src1_csv(spark, sf_dir):
    return R.read_csv(spark, _items_csv(spark, sf_dir), ",")


def src7_items(spark, sf_dir):
    names = _ITEMS[1:8]
    return R.read_items(spark, _items_csv(spark, sf_dir), R.ColumnMap({n: n for n in names}, required=names), sep=",")


def src9_turns(spark, sf_dir):
    path, root = _at(spark)
    t = table(spark, sf_dir, "syn_020").select(F.col("schema_id").alias("schema"), "conversation_id", "turn_index", "timestamp", "timestamp_raw", "speaker_id", "speaker_role", "text", "provenance")
    K.write_conversations(t, path, root, folders=16)
    return R.read_turns(spark, path).select("conversation_id", "turn_index", "speaker_id", "text", F.col("provenance.source_file").alias("source_file"), F.col("provenance.source_row").alias("source_row"))


def src10_tables(spark, sf_dir):
    names = ("annotators", "field_catalog", "nation", "region", "threads")
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(f"held_{n}")
    return R.describe_tables(spark, [f"held_{n}" for n in names]).withColumn("name", F.expr("substr(name, 6)"))


def src13_sheet(spark, sf_dir):
    """One judgement for each item of one annotator, as a filled sheet."""
    path, root = _at(spark)
    label = F.trim("label")
    rows = table(spark, sf_dir, "annotations").filter("annotator_id = 'ANN-03' and item_id is not null and conversation_id is not null")
    first = rows.groupBy("item_id").agg(F.min_by(F.struct("conversation_id", "turn_index", "field_name", F.when(label.isin(*S.LABELS), label).alias("label"), "value"), "annotation_id").alias("x"))
    K.write_csv(K.sheet(first.select("item_id", "x.*")), path, root, ["item_id"], single=False)
    return R.read_sheet(R.read_csv(spark, path, ","), S.LABELS)


def src15_map(spark, sf_dir):
    path, root = _at(spark)
    K.write_document({r[0]: r[1] for r in table(spark, sf_dir, "action_catalog").select("action_name", "meaning").collect()}, f"{path}.json", root)  # a small table
    return R.read_map(spark, f"{path}.json")


def src3_rows(spark, sf_dir):
    path, root = _at(spark)
    K.write_document({"rows": [r.asDict() for r in table(spark, sf_dir, "field_catalog").orderBy("field_name").collect()]}, f"{path}.json", root)  # a small table
    return R.read_json_rows(spark, f"{path}.json", ["field_name", "field_type", "field_description"])


def snk4_audit(spark, sf_dir):
    """Records of an audit by kind: the warning, both maps, and an entry for each turn."""
    path, root = _at(spark)
    t = table(spark, sf_dir, "syn_020").select("conversation_id", "speaker_id", F.col("turn_id").alias("turn"), F.col("text").alias("original"))
    ids = t.select(F.col("conversation_id").alias("source_conversation_id"), F.sha2("conversation_id", 256).alias("conversation_id")).distinct()
    who = t.select("conversation_id", F.col("speaker_id").alias("speaker"), F.sha2("speaker_id", 256).alias("speaker_id")).distinct()
    K.write_audit(t.select("conversation_id", "turn", "original"), path, root, ids, who)
    return spark.read.json(path).groupBy("record").agg(F.count("*").alias("n"), F.count_distinct("conversation_id").alias("conversations"), F.count("original").alias("originals"))


def snk5_sheets(spark, sf_dir):
    path, root = _at(spark)
    K.write_sheets(table(spark, sf_dir, "annotations"), path, root, "annotator_id")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(R.strings([*K.SHEET_COLUMNS, "_a"])).csv(path)
    return back.select(F.col("_a").alias("annotator_id"), *[blank_to_null(c).alias(c) for c in ("item_id", "turn_index", "label", "value")])


def snk7_scored(spark, sf_dir):
    path, root = _at(spark)
    K.write_scored(table(spark, sf_dir, "items").filter("split in ('train', 'dev')").select("row_no", "split", "action"), path, root)
    return spark.read.schema("row_no bigint, split string, action string").json(path)


QUERIES = {
    "src1_csv": src1_csv, "src3_rows": src3_rows, "src7_items": src7_items, "src9_turns": src9_turns, "src10_tables": src10_tables, "src13_sheet": src13_sheet, "src15_map": src15_map,
    "snk4_audit": snk4_audit, "snk5_sheets": snk5_sheets, "snk7_scored": snk7_scored,
}

_COLS = ("annotators", "field_catalog", "nation", "region", "threads")
_L = ", ".join(f"'{x}'" for x in S.LABELS)
ORACLES = {
    "src1_csv": "SELECT " + ", ".join(f"nullif({c}::VARCHAR, '') AS {c}" for c in _ITEMS) + " FROM items",  # an empty cell is null
    "src3_rows": "SELECT (row_number() OVER (ORDER BY field_name) - 1)::INT AS source_row, field_name, field_type, field_description FROM field_catalog",
    "src7_items": f"SELECT row, coalesce({blank('item_id')}, 'row-' || row) AS item_id, turn_index, " + ", ".join(f"{blank(c)} AS {c}" for c in ("conversation_id", "user_message", "action", "reply", "labeler")) + " FROM (SELECT *, (row_number() OVER (ORDER BY row_no) + 1)::INT AS row FROM items)",
    "src9_turns": "SELECT conversation_id, turn_index, speaker_id, text, provenance.source_file AS source_file, provenance.source_row AS source_row FROM syn_020",
    "src10_tables": " UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM pragma_table_info('{n}')) AS columns, (SELECT count(*) FROM {n}) AS rows" for n in _COLS),
    "src13_sheet": f"SELECT {blank('item_id')} AS item_id, {blank('conversation_id')} AS conversation_id, turn_index::VARCHAR AS turn_index, {blank('field_name')} AS field_name, CASE WHEN trim(label) IN ({_L}) THEN trim(label) END AS label, {blank('value')} AS value FROM annotations WHERE annotator_id = 'ANN-03' AND item_id IS NOT NULL AND conversation_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY annotation_id) = 1",
    "src15_map": "SELECT action_name AS key, meaning AS value FROM action_catalog",
    "snk4_audit": "SELECT 'warning' AS record, 1::BIGINT AS n, 0::BIGINT AS conversations, 0::BIGINT AS originals UNION ALL SELECT 'conversation_id_map', count(DISTINCT coalesce(conversation_id, '?')), count(DISTINCT conversation_id), 0 FROM syn_020 UNION ALL SELECT 'speaker_map', count(*), count(DISTINCT conversation_id), 0 FROM (SELECT DISTINCT conversation_id, speaker_id FROM syn_020) UNION ALL SELECT 'entry', count(*), count(DISTINCT conversation_id), count(text) FROM syn_020",
    "snk5_sheets": f"SELECT annotator_id, {blank('item_id')} AS item_id, turn_index::VARCHAR AS turn_index, {blank('label')} AS label, {blank('value')} AS value FROM annotations",
    "snk7_scored": "SELECT row_no, split, action FROM items WHERE split = 'dev'",
}

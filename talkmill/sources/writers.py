"""Writers: every path must lie under a root, nothing frozen is overwritten, sheets are projected so no extra column leaks."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.operators.sampling import hash_key

SHEET_COLUMNS = ("item_id", "conversation_id", "turn_index", "field_name", "field_type", "turn_text", "label", "value", "notes")


#: Cells come back as they were: no blank is cut, quotes are doubled.
AS_IS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def planned(paths: list[str], root: str) -> list[tuple[str, bool]]:
    """A dry run: where each would be written, and whether something is there already."""
    return [(p := contained(x, root), os.path.exists(p)) for x in paths]


def contained(path: str, root: str) -> str:
    """The path if it lies under the root once links are followed."""
    p, r = Path(os.path.realpath(path)), Path(os.path.realpath(root))
    if p != r and r not in p.parents:
        raise ValueError(f"{path} is outside of {root}")
    return str(p)


def apart(inputs: str, outputs: str) -> None:
    """Inputs and outputs must not lie in each other."""
    a, b = Path(os.path.realpath(inputs)), Path(os.path.realpath(outputs))
    if a == b or a in b.parents or b in a.parents:
        raise ValueError("input and output folders lie in each other")


def write_csv(df: DataFrame, path: str, root: str, keys: list[str], single: bool = True) -> None:
    """One globally ordered CSV; `single` brings it into one file, which only exports of bounded size should ask for."""
    out = df.orderBy(*keys)
    (out.coalesce(1) if single else out).write.mode("errorifexists").options(**AS_IS).csv(contained(path, root))


def write_conversations(df: DataFrame, path: str, root: str, conversation: str = "conversation_id", folders: int | None = None) -> None:
    """JSON lines by conversation. Rows of a conversation are brought together by a range partition, so a large one may span files.

    Each has a folder of its own; with `folders` that many are shared, by hash, as a file system bears no folder for each of millions.
    """
    held = df.withColumn("_c", F.pmod(F.xxhash64(conversation), F.lit(folders)) if folders else F.col(conversation))
    held.repartitionByRange("_c", conversation).sortWithinPartitions("_c", conversation).write.mode("errorifexists").partitionBy("_c").json(contained(path, root))


def write_document(document: dict, path: str, root: str) -> None:
    """A small JSON report, keys in order."""
    p = Path(contained(path, root))
    p.parent.mkdir(parents=True, exist_ok=True)
    with p.open("x", encoding="utf-8") as f:
        json.dump(document, f, indent=2, sort_keys=True, ensure_ascii=False)


def write_audit(audit: DataFrame, path: str, root: str, ids: DataFrame | None = None, speakers: DataFrame | None = None) -> None:
    """Replacements as JSON lines after a warning record, and the maps of ids and speakers. Holds originals: for restricted storage only.

    `ids` has source_conversation_id and conversation_id, `speakers` has conversation_id, speaker and speaker_id.
    """
    warning = audit.sparkSession.createDataFrame([("warning", "holds original personal data")], "record string, note string")
    out = warning
    for name, part in (("conversation_id_map", ids), ("speaker_map", speakers), ("entry", audit)):
        if part is not None:
            out = out.unionByName(part.withColumn("record", F.lit(name)), allowMissingColumns=True)
    out.write.mode("errorifexists").json(contained(path, root))


def sheet(df: DataFrame) -> DataFrame:
    """Fixed columns only; missing ones come out empty."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in SHEET_COLUMNS])


def write_sheets(df: DataFrame, path: str, root: str, annotator: str = "annotator") -> None:
    """One folder of sheets for each annotator."""
    own = [(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in SHEET_COLUMNS]
    out = df.select(F.col(annotator).alias("_a"), *own)
    out.write.mode("errorifexists").partitionBy("_a").options(**AS_IS).csv(contained(path, root))


def recheck(items: DataFrame, n: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """A blind sheet of n labelled items and its answer key, in one seeded order."""
    drawn = items.filter(F.col("action").isNotNull()).withColumn("_h", hash_key(seed, "row")).orderBy("_h", "row").limit(n)
    blind = drawn.select("item_id", "user_message", F.lit("").alias("action"))
    return blind, drawn.select("item_id", "action")


def write_scored(rows: DataFrame, path: str, root: str, split: str = "split") -> None:
    """Per-item results of the dev split; rows of test raise."""
    ok = F.when(F.col(split) == "test", F.raise_error(F.lit("test items are not written out")).cast("string")).otherwise(F.col(split))
    rows.withColumn(split, ok).filter(F.col(split) == "dev").write.mode("errorifexists").json(contained(path, root))

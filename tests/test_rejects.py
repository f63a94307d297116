import random

from talkmill.operators.rejects import load_records, read_records, split_records


def plain_split(text, sep):
    """Field by field, sign by sign."""
    fields, i = [], 0
    while True:
        if text[i : i + 1] == '"':
            j, out = i + 1, ""
            while True:
                if j >= len(text):
                    return True, None
                if text[j] == '"' and text[j + 1 : j + 2] == '"':
                    out, j = out + '"', j + 2
                elif text[j] == '"':
                    break
                else:
                    out, j = out + text[j], j + 1
            j += 1
            if j < len(text) and text[j] != sep:
                return True, None
        else:
            j = text.find(sep, i)
            j = len(text) if j < 0 else j
            out = text[i:j]
        fields.append(out)
        if j >= len(text):
            return False, fields
        i = j + 1


def test_against_plain_reading():
    rnd = random.Random(3)
    for sep in ",\t;":
        texts = ["".join(rnd.choice(['"', '"', sep, sep, "a", "é", " ", "\n", '""', f'{sep}"', f'"{sep}']) for _ in range(rnd.randrange(0, 14))) or "x" for _ in range(4000)]
        broken, fields = split_records(texts, sep)
        for t, b, f in zip(texts, broken, fields):
            want_b, want_f = plain_split(t, sep)
            assert b == want_b, t
            if not b:
                assert f == want_f, t


def test_reasons(spark):
    rows = [
        (1, "f", "i,C1,1,hello,Go,reply,l"), (2, "f", None), (3, "f", "  \r"), (4, "f", 'i,C1,1,"open,Go,r,l'), (5, "f", 'i,C1,1,"a" b,Go,r,l'), (6, "f", "i,C1,1"),
        (7, "f", "i,,1,hello,go,r,l"), (8, "f", "i,C1,x,hello,go,r,l"), (9, "f", "i,C1,,hello,nope,r,l"), (10, "f", "i,C1,,he\x07llo,go,r,l"), (11, "t", '﻿i\tC1\t 07 \t"a ""b""\tc\nd"\t\t\tl\r'),
        (12, "f", "item_id,conversation_id,turn_index,user_message,action,reply,labeler"), (13, None, 'i,C1,99999999999,a "b" c,GO ,,'), (13, None, 'i,C1,99999999999,a "b" c,GO ,,'), (14, "f", ""),
    ]
    lines = spark.createDataFrame([(*r, "clash") for r in rows], "line_id long, source_file string, raw_line string, _sep string")
    files = spark.createDataFrame([("f", ","), ("t", "\t"), (None, ";")], "source_file string, field_sep string")
    acts = spark.createDataFrame([("go",), (None,)], "action_name string")
    got = load_records(lines, files, acts).collect()
    assert sorted((r.line_id, r.reason) for r in got if r.reason) == [(2, "column_count"), (3, "column_count"), (4, "quoting"), (5, "quoting"), (6, "column_count"), (7, "value"), (8, "value"), (9, "value"), (10, "value"), (12, "value"), (14, "column_count")]
    fine = {r.line_id: r for r in got if not r.reason}
    assert fine[11].user_message == 'a "b"\tc\nd' and fine[11].turn_index == 7 and fine[11].action is None
    assert fine[13].turn_index is None and fine[13].user_message == 'a "b" c' and fine[13].action == "go"
    assert load_records(lines.limit(0), files.limit(0), acts.limit(0)).count() == 0


def records_of(text: str, sep: str) -> list[str]:
    """One by one: a line break ends a record unless a quoted field is open; the last one of a file is no data."""
    if not text:
        return []
    text = text.removesuffix("\n")
    out, start, k, at_field, inside = [], 0, 0, True, False
    broken = False
    while k < len(text):
        ch = text[k]
        if inside:
            if ch == '"' and text[k + 1 : k + 2] == '"':
                k += 1
            elif ch == '"':
                inside = False
                nxt = text[k + 1 : k + 2]
                broken = nxt not in ("", sep, "\n") and not (nxt == "\r" and text[k + 2 : k + 3] in ("", "\n"))
        elif ch == "\n":
            out.append(text[start:k])
            start, broken = k + 1, False
        elif ch == '"' and at_field and not broken:
            inside = True
        at_field = not inside and ch in (sep, "\n") if not (ch == '"' and inside) else False
        k += 1
    return [*out, text[start:]]


def test_records_of_raw_files(spark, tmp_path):
    """Quoted line breaks, plain and stray quotes, in files cut into splits of a few bytes, against a walk sign by sign."""
    rnd = random.Random(12)
    pieces = ["a", "bc", '"x"', '"p\nq"', '"p""\n\nq"', 'd"e', "", '"u,v"', '"w"z', '"\n"', '"long\nlines\nof\ntext"', "é", '""', '"x"\r']
    want = {}
    for f in range(12):
        text = "".join(",".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 5))) + "\n" for _ in range(rnd.randrange(0, 60)))
        text = text[:-1] if f % 3 == 0 else text + ('"never closed\nto the end' if f == 1 else "")
        (tmp_path / f"f{f:02d}.csv").write_bytes(text.encode())
        want[f"f{f:02d}.csv"] = records_of(text, ",")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("64", "1000", held):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = {}
            for r in sorted(read_records(spark, str(tmp_path)).collect(), key=lambda r: (r.source_file, r.block, r.line)):
                got.setdefault(r.source_file, []).append(r.raw_line)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", held)
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == {k: v for k, v in want.items() if v}

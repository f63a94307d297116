"""SQL for the general data-pipeline queries."""

_FIELD = {s: f'(?:"(?:[^"]|"")*"|[^"{s}][^{s}]*|)' for s in (",", "\t")}


_CELL = "CASE WHEN starts_with({0}, '\"') THEN replace({0}[2:-2], '\"\"', '\"') ELSE {0} END"
_STRIP = "regexp_replace({0}, '^[\\s\\x{{00a0}}\\x{{feff}}]+|[\\s\\x{{00a0}}\\x{{feff}}]+$', '', 'g')"


def _sheet(sep: str, test: str) -> str:
    f, s = _FIELD[sep], "chr(9)" if sep == "\t" else "','"
    q = f.replace("\t", "\\t")
    sep_re = "\\t" if sep == "\t" else ","
    part = lambda k: f"regexp_extract(line, '^(?s:(?:{q}{sep_re}){{{k}}}({q}))', 1)"
    names = ("item_id", "conversation_id", "turn_index", "user_message", "action", "reply", "labeler")
    cols = ", ".join(f"{part(k)} AS {n}" for k, n in enumerate(names))
    return f"""SELECT line_id, source_file, blank, regexp_full_match(line, '(?s:{q}(?:{sep_re}{q})*)') AS fine,
      length(regexp_replace(line, '(?s)(^|{sep_re})"(?:[^"]|"")*"', '\\1', 'g')) - length(replace(regexp_replace(line, '(?s)(^|{sep_re})"(?:[^"]|"")*"', '\\1', 'g'), {s}, '')) + 1 AS n_fields, {cols}
      FROM lines WHERE {test}"""


_CELLS = ", ".join(f"nullif({_STRIP.format(_CELL.format(c))}, '') AS {c}" for c in ("item_id", "reply", "labeler"))

P7 = f"""WITH lines AS (SELECT line_id, source_file, coalesce(sep, ',') AS sep, regexp_replace(regexp_replace(coalesce(raw_line, ''), '^﻿', ''), '\\r$', '') AS line,
    regexp_full_match(regexp_replace(regexp_replace(coalesce(raw_line, ''), '^﻿', ''), '\\r$', ''), '(?s)\\s*') AS blank
  FROM sheet_lines LEFT JOIN (SELECT source_file, max(field_sep) AS sep FROM source_files GROUP BY 1) USING (source_file)),
cut AS ({_sheet(",", "sep = ','")} UNION ALL {_sheet(chr(9), "sep = chr(9)")}),
plain AS (SELECT *, CASE WHEN starts_with(user_message, '"') THEN replace(user_message[2:-2], '""', '"') ELSE user_message END AS msg,
    trim(trim(CASE WHEN starts_with(conversation_id, '"') THEN conversation_id[2:-2] ELSE conversation_id END), chr(9)) AS conv,
    trim(CASE WHEN starts_with(turn_index, '"') THEN turn_index[2:-2] ELSE turn_index END) AS turn,
    lower(trim(CASE WHEN starts_with(action, '"') THEN action[2:-2] ELSE action END)) AS act FROM cut),
judged AS (SELECT line_id, CASE WHEN NOT fine AND NOT blank THEN 'quoting' WHEN blank OR n_fields <> 7 THEN 'column_count'
    WHEN conv = '' OR regexp_full_match(msg, '(?s)\\s*') OR NOT regexp_full_match(turn, '[0-9]*') OR (act <> '' AND act NOT IN (SELECT lower(trim(action_name)) FROM action_catalog))
      OR regexp_matches(msg, '[\\x{{fffd}}\\x{{0}}-\\x{{8}}\\x{{b}}\\x{{c}}\\x{{e}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}]') THEN 'value' END AS reason,
    {_CELLS}, conv, turn, act, msg, source_file FROM plain)
"""

ORACLES = {
    "p7_found": P7 + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p7_loaded": P7 + f"SELECT line_id, source_file, item_id, {_STRIP.format('conv')} AS conversation_id, try_cast(turn AS INTEGER) AS turn_index, CASE WHEN turn <> '' AND try_cast(turn AS INTEGER) IS NULL THEN turn END AS turn_index_text, msg AS user_message, nullif(act, '') AS action, reply, labeler FROM judged WHERE reason IS NULL",
    "p7_files": P7 + f"SELECT item_id, {_STRIP.format('conv')} AS conversation_id, try_cast(turn AS INTEGER) AS turn_index, msg AS user_message, nullif(act, '') AS action, reply, labeler FROM judged WHERE reason IS NULL",
}

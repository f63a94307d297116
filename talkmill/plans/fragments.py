"""Pieces of SQL that several oracles share. Patterns are made from the same word lists in the form of an engine without lookaround."""

from __future__ import annotations

import re

from talkmill.functions import text as X

W = r"[\pL\pN_]"
NW = r"[^\pL\pN_]"


def one_of(words) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ").replace("'", "''") for w in words)


def cue(c: str, words) -> str:
    return f"regexp_matches({c}, '(?i)(^|{NW})(?:{one_of(words)})($|{NW})')"


def field(c: str, name: str) -> str:
    hit = f"regexp_matches({c}, '(?i)(^|[^a-z])(?:{one_of(X.FIELD_WORDS[name])})($|[^a-z])')"
    if name == "budget":
        hit += f" OR regexp_matches({c}, '(?i)[0-9][0-9,.]*\\s*(?:thousand|crores|lakhs|crore|lakh|lacs|lac|cr|k|l)($|{NW})')"
    if name == "location_preference":
        hit += f" OR regexp_matches({c}, '(?i)(^|{NW}){W}{{3,}}(?:{'|'.join(X.LOCALITY_ENDINGS)})($|{NW})')"
    return f"({hit})"


def any_field(c: str) -> str:
    return "(" + " OR ".join(field(c, f) for f in sorted(X.FIELD_WORDS)) + ")"


def words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^\\s\\pZ]+'))"


def message(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize({c})), 'ß', 'ss'), '[^\\pL\\pN_\\s]', ' ', 'g'), '[\\s\\pZ]+', ' ', 'g'))"


def reply(c: str) -> str:
    return f"regexp_replace({message(c)}, '\\p{{Nd}}+', '#', 'g')"


def blank(c: str) -> str:
    return f"nullif(trim({c}), '')"


ITEMS = "i AS (SELECT row_no AS row, coalesce(nullif(trim(item_id), ''), 'row-' || row_no) AS item_id, turn_index, " + ", ".join(f"{blank(c)} AS {c}" for c in ("conversation_id", "user_message", "action", "reply", "labeler", "split")) + " FROM items)"

TURNS = "t AS (SELECT turn_id, conversation_id AS conversation, turn_index, coalesce(nullif(trim(speaker_role), ''), 'unknown') AS role, coalesce(speaker_id, '') AS speaker, coalesce(text, '') AS text, provenance.source AS source FROM syn_020)"

MEDIA = "starts_with(lower(trim(text)), '[media:')"
REASON = f"CASE WHEN role <> 'customer' THEN 'not_customer' WHEN {MEDIA} THEN 'media_placeholder' WHEN trim(text) = '' THEN 'empty' WHEN {words('text')} < {X.MIN_TARGET_WORDS} THEN 'too_short' END"
MEDIA_KIND = "CASE lower(trim(text)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.MEDIA_KINDS.items()) + " ELSE 'other' END"


def block(source: str, value: str) -> str:
    """The percentile block of an integer column of a table expression."""
    return f"SELECT count(v) AS n, coalesce(avg(v), 0.0)::DOUBLE AS mean, coalesce(median(v), 0.0)::DOUBLE AS median, coalesce(list_sort(list(v))[greatest(1, least(count(v), round_even(0.9 * count(v), 0)::BIGINT))], 0) AS p90, coalesce(max(v), 0) AS max, coalesce(min(v), 0) AS min FROM (SELECT {value} AS v FROM {source} WHERE {value} IS NOT NULL)"


def long(source: str, parts: dict[tuple[str, str], str]) -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS section, '{n.replace(chr(39), chr(39) * 2)}' AS name, ({a})::BIGINT AS n FROM {source}" for (s, n), a in parts.items())


def sha(*parts: str) -> str:
    return "sha256(concat_ws(':', " + ", ".join(parts) + "))"

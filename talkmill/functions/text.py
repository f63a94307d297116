"""Column functions over text, and the fixed word lists they use.

All are native expressions (they stay in generated code) but for the compatibility form and case folding of non-ASCII texts,
which Spark lacks: those go through one Arrow function, while plain ASCII texts take the native way.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words dropped from names, words that keep their s
STOPWORDS = ("the", "a", "an", "of", "for", "to", "in", "on", "at", "by", "with", "and", "or", "is", "be")
NEVER_SINGULAR = ("this", "has", "was", "its", "does", "goes", "news", "plus", "series", "species", "always", "sometimes")

# fixed values: cues of a correction and of a hedge, and those of them that are not English
CORRECTION_CUES = ("actually", "sorry", "i meant", "i mean", "no wait", "scratch that", "instead", "correction", "my mistake", "rather than", "not that", "change that", "ignore that", "change", "kaadu", "ledu ledu", "matlab", "nahi nahi")
HEDGE_CUES = (
    "around", "approximately", "roughly", "maybe", "might", "perhaps", "or so", "ballpark", "up to", "at least", "somewhere", "thereabouts", "flexible", "depends", "not sure", "probably", "could be", "give or take", "around about",
    "konchem", "approx ga", "emo", "anukuntunna", "chuddam", "alochistanu", "telidu", "shayad", "lagbhag", "thoda", "dekhte hain", "pata nahi",
)
CODE_MIXED_CUES = ("kaadu", "ledu ledu", "matlab", "nahi nahi", "konchem", "approx ga", "emo", "anukuntunna", "chuddam", "alochistanu", "telidu", "shayad", "lagbhag", "thoda", "dekhte hain", "pata nahi")

# fixed values: words that mention a field
FIELD_WORDS = {
    "budget": ("budget", "price", "cost", "afford", "lakh", "lakhs", "lac", "lacs", "crore", "crores", "cr", "loan", "emi", "down payment", "all inclusive", "negotiable", "rupees"),
    "property_type": ("bhk", "flat", "apartment", "villa", "plot", "house", "duplex", "penthouse", "studio", "independent", "row house", "builder floor", "bungalow"),
    "location_preference": ("near", "nearby", "close to", "locality", "area", "vicinity", "side", "zone", "metro", "highway", "school", "office"),
    "timeline": (
        "possession", "ready", "immediately", "asap", "soon", "week", "weeks", "month", "months", "year", "years", "quarter", "handover", "move in", "shifting", "timeline",
        "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "diwali", "ugadi", "pongal",
    ),
    "decision_maker": (
        "wife", "husband", "spouse", "father", "mother", "dad", "mom", "parents", "brother", "sister", "son", "daughter", "family", "in-laws", "partner", "uncle", "aunt",
        "decide", "decides", "sign off", "approval", "discuss with", "check with",
    ),
}
LOCALITY_ENDINGS = ("nagar", "puram", "halli", "pura", "pur", "abad", "guda", "palli", "wadi", "ganj", "colony", "layout", "enclave", "township", "vihar", "kunj", "garh")
STRATA = ("field_mention", "correction", "hedge", "multi_speaker", "plain")

# fixed values: media placeholders and their kinds; reasons of rejection in order; the least words of a target
MEDIA_KINDS = {"[media: voice note]": "voice", "[media: image]": "image", "[media: video]": "video", "[media: document]": "document", "[media: contact card]": "contact", "[media: unsupported]": "unsupported"}
MEDIA_ORDER = ("voice", "image", "video", "document", "contact", "unsupported", "other")
MIN_TARGET_WORDS = 3

W = r"[\p{L}\p{N}_]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    t = F.trim(col(c))
    return F.when(t != "", t)


# -- names -----------------------------------------------------------------------------------------------------------
def name_tokens(c: Column | str) -> Column:
    """Camel case and `_`, `-`, blanks split; lower case."""
    spaced = F.regexp_replace(col(c), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[_\-\s]+"), lambda x: x != "")


def singular(x: Column) -> Column:
    n = F.length(x)
    drop = lambda k: F.substring(x, F.lit(1), n - k)
    return (
        F.when(x.isin(*NEVER_SINGULAR) | (n <= 3), x)
        .when(x.rlike("(ss|us|is)$"), x)
        .when(x.endswith("ies") & (n > 4), F.concat(drop(3), F.lit("y")))
        .when(x.rlike("(ses|xes|zes|ches|shes)$"), drop(2))
        .when(x.endswith("s"), drop(1))
        .otherwise(x)
    )


def exact_name(c: Column | str) -> Column:
    """N0: lower case without outer blanks."""
    return F.lower(F.trim(col(c)))


def split_name(c: Column | str) -> Column:
    """N1: the tokens joined by one blank."""
    return F.array_join(name_tokens(c), " ")


def stem_name(c: Column | str) -> Column:
    """N2: singular tokens without stop words; may be empty, which is a key like any other."""
    return F.array_join(F.filter(F.transform(name_tokens(c), singular), lambda x: ~x.isin(*STOPWORDS)), " ")


NAME_FORMS = {"N0": exact_name, "N1": split_name, "N2": stem_name}


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


# -- messages --------------------------------------------------------------------------------------------------------
def _fold(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in text.to_pylist()], pa.string())


_fold.__annotations__ = {"text": pa.Array, "return": pa.Array}


def folded(c: Column | str) -> Column:
    """Compatibility form, case folded."""
    c = col(c)
    slow = F.arrow_udf(_fold, "string")
    return F.when(c.rlike(r"^[\x00-\x7f]*$"), F.lower(c)).otherwise(slow(F.when(~c.rlike(r"^[\x00-\x7f]*$"), c)))


def normalise_message(c: Column | str) -> Column:
    """Folded, punctuation to blanks, blanks collapsed; digits stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(c), r"[^\p{L}\p{N}_\s]", " "), r"[\s\p{Z}]+", " "))


def normalise_reply(c: Column | str) -> Column:
    """As a message, then digit runs to #."""
    return F.regexp_replace(normalise_message(c), r"\p{Nd}+", "#")


def stable_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, 12)


def word_count(c: Column | str) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(r"[^\s\p{Z}]+"))


def normal_label(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


# -- cues ------------------------------------------------------------------------------------------------------------
def _one_of(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def cue_pattern(words: tuple[str, ...]) -> str:
    """Whole words, for Spark."""
    return rf"(?iu)(?<!{W})(?:{_one_of(words)})(?!{W})"


def field_pattern(words: tuple[str, ...]) -> str:
    """Bounded by letters a to z only, so that 3bhk holds bhk."""
    return rf"(?i)(?<![a-z])(?:{_one_of(words)})(?![a-z])"


AMOUNT_PATTERN = rf"(?i)[0-9][0-9,.]*\s*(?:thousand|crores|lakhs|crore|lakh|lacs|lac|cr|k|l)(?!{W})"
LOCALITY_PATTERN = rf"(?iu)(?<!{W}){W}{{3,}}(?:{'|'.join(LOCALITY_ENDINGS)})(?!{W})"


def has_cue(c: Column | str, words: tuple[str, ...]) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(cue_pattern(words))


def mentions(c: Column | str, field: str) -> Column:
    """Whether a text mentions a field: by its words, by an amount (budget) or a locality (location)."""
    c = F.coalesce(col(c), F.lit(""))
    hit = c.rlike(field_pattern(FIELD_WORDS[field]))
    if field == "budget":
        hit = hit | c.rlike(AMOUNT_PATTERN)
    if field == "location_preference":
        hit = hit | c.rlike(LOCALITY_PATTERN)
    return hit


def fields_mentioned(c: Column | str) -> Column:
    return F.array_compact(F.array(*[F.when(mentions(c, f), f) for f in sorted(FIELD_WORDS)]))


def strata(text: Column | str, speakers: Column) -> Column:
    """Sorted strata of a turn; `speakers` is the number of distinct speakers in its window."""
    found = F.array_compact(
        F.array(
            F.when(has_cue(text, CORRECTION_CUES), "correction"), F.when(F.size(fields_mentioned(text)) > 0, "field_mention"), F.when(has_cue(text, HEDGE_CUES), "hedge"), F.when(speakers >= 3, "multi_speaker")
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("plain"))).otherwise(found)


# -- scripts, media, rejection ---------------------------------------------------------------------------------------
SCRIPTS = {"telugu": r"[\x{0C00}-\x{0C7F}]", "devanagari": r"[\x{0900}-\x{097F}]"}


def script_flags(c: Column | str) -> dict[str, Column]:
    """Buckets, not exclusive, of the scripts in a text."""
    c = F.coalesce(col(c), F.lit(""))
    tel, dev = c.rlike(SCRIPTS["telugu"]), c.rlike(SCRIPTS["devanagari"])
    ascii_only = c.rlike(r"^[\x00-\x7f]*$")
    return {"telugu": tel, "devanagari": dev, "other_non_ascii": ~ascii_only & ~tel & ~dev, "ascii_only": ascii_only, "non_ascii_letter": c.rlike(r"[\p{L}&&[^\x00-\x7f]]")}


def is_media(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(col(c), F.lit("")))).startswith("[media:")


def media_kind(c: Column | str) -> Column:
    """Kind of a media placeholder, `other` outside the list, null for other texts."""
    t = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    out = F.lit("other")
    for text, kind in MEDIA_KINDS.items():
        out = F.when(t == text, kind).otherwise(out)
    return F.when(is_media(c), out)


def rejection(role: Column | str, text: Column | str) -> Column:
    """First reason that holds why a turn is no target; null for targets."""
    t = F.trim(F.coalesce(col(text), F.lit("")))
    return F.when(F.coalesce(col(role), F.lit("")) != "customer", "not_customer").when(is_media(text), "media_placeholder").when(t == "", "empty").when(word_count(text) < MIN_TARGET_WORDS, "too_short")


def remap(c: Column | str, mapping: dict[str, str]) -> Column:
    """Mapped values, others as they are."""
    c = col(c)
    if not mapping:
        return c
    held = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(held[c], c)


# -- prompts and answers ---------------------------------------------------------------------------------------------
def embedding_input(name: Column | str, description: Column | str) -> Column:
    """`name: description`; a missing description is empty."""
    return F.concat(col(name), F.lit(": "), F.coalesce(col(description), F.lit("")))


def render(template: str, vocabulary: Column, conversation: Column, fewshot: Column) -> Column:
    """The three placeholders replaced one after the other, literally."""
    out = F.lit(template)
    for mark, value in (("{{vocabulary}}", vocabulary), ("{{conversation}}", conversation), ("{{fewshot}}", fewshot)):
        out = F.replace(out, F.lit(mark), value)
    return out


def context_lines(turns: Column) -> Column:
    """`role: text` lines of an array of structs."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")


def answer(c: Column | str, vocabulary: Column) -> Column:
    """The label in a model's answer: a JSON object's action, else the first line (after an optional `action:`) in the vocabulary, else the text."""
    t = F.trim(col(c))
    lines = F.transform(F.split(t, "\n"), lambda x: normal_label(F.regexp_replace(F.trim(x), r"(?i)^action\s*:\s*", "")))
    known = F.filter(lines, lambda x: F.array_contains(vocabulary, x))
    return F.coalesce(F.when(t.startswith("{"), normal_label(F.get_json_object(t, "$.action"))), F.try_element_at(known, F.lit(1)), normal_label(t))


def first_line(c: Column | str) -> Column:
    return normal_label(F.regexp_replace(F.split(F.trim(col(c)), "\n")[0], r"(?i)^action\s*:\s*", ""))

import pytest
from pyspark.sql import functions as F

from talkmill.functions import text as X
from talkmill.functions import values as V


def col(spark, make, *values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(make(F.col("v")).alias("o")).collect()]


def test_names(spark):
    names = ["CheckIn_date", "to", "addresses", "series", "  Number-Of  Boxes ", "cities", "this", "", None, "class bus analysis"]
    assert col(spark, X.split_name, *names) == ["check in date", "to", "addresses", "series", "number of boxes", "cities", "this", "", None, "class bus analysis"]
    assert col(spark, X.stem_name, *names) == ["check date", "", "address", "series", "number box", "city", "this", "", None, "class bus analysis"]
    assert col(spark, X.exact_name, " A B ") == ["a b"]


def test_messages(spark):
    assert col(spark, X.normalise_message, "Hello,  WORLD!", "Straße", "STRASSE", "ﬁne №5", "Café—bar", "", None, "🙂") == ["hello world", "strasse", "strasse", "fine no5", "café bar", "", None, ""]
    assert col(spark, X.normalise_reply, "Call 98,765 or १२") == ["call # # or #"]
    assert col(spark, X.stable_hash, "abc") == ["ba7816bf8f01"]
    assert col(spark, X.word_count, "a  b\nc", "", None, "  ") == [3, 0, 0, 0]
    assert col(spark, X.normal_label, "  Book \t Visit ") == ["book visit"]


def test_cues(spark):
    has = lambda *w: (lambda c: X.has_cue(c, w))
    assert col(spark, has("change", "i meant"), "Change it", "exchange", "sorry I MEANT two", None, "changé") == [True, False, True, False, False]
    assert col(spark, X.fields_mentioned, "3BHK near school for 80 lakhs", "my wife", "Kondapuram please", "5k ok", "abhk") == [["budget", "location_preference", "property_type"], ["decision_maker"], ["location_preference"], ["budget"], []]
    strata = lambda c: X.strata(c, F.lit(3))
    assert col(spark, strata, "maybe 80 lakhs actually", "hm") == [["correction", "field_mention", "hedge", "multi_speaker"], ["multi_speaker"]]
    assert col(spark, lambda c: X.strata(c, F.lit(1)), "hm") == [["plain"]]


def test_rejection_order(spark):
    rows = [("agent", "[media: image]"), ("customer", " [Media: voice note] "), ("customer", "  "), ("customer", "two words"), ("customer", "now three words"), (None, "x y z"), ("customer", None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, role string, text string").orderBy("k")
    assert [r[0] for r in df.select(X.rejection("role", "text")).collect()] == ["not_customer", "media_placeholder", "empty", "too_short", None, "not_customer", "empty"]
    assert col(spark, X.media_kind, "[media: image]", "[MEDIA: sticker]", "text") == ["image", "other", None]


def test_answers_and_prompts(spark):
    vocab = F.array(F.lit("book visit"), F.lit("clarify"))
    assert col(spark, lambda c: X.answer(c, vocab), '{"action": "Clarify"}', "hm\nAction: Book  Visit\nclarify", "else") == ["clarify", "book visit", "else"]
    assert col(spark, X.first_line, "action: A b\nc") == ["a b"]
    assert col(spark, lambda c: X.render("[{{vocabulary}}] {{conversation}} {{fewshot}}", F.lit("v"), c, F.lit("f")), "a {{fewshot}}") == ["[v] a f f"]
    assert col(spark, lambda c: X.context_lines(F.array(F.struct(F.lit("customer").alias("role"), c.alias("text")))), "hi") == ["customer: hi"]
    assert col(spark, lambda c: X.remap(c, {"a": "b"}), "a", "z", None) == ["b", "z", None]


def test_scripts_and_jaccard(spark):
    flags = spark.createDataFrame([("నా",), ("की",), ("₹5",), ("ok",), ("é",)], "t string").select(*[c.alias(k) for k, c in X.script_flags("t").items()]).collect()
    assert [tuple(r) for r in flags] == [(True, False, False, False, True), (False, True, False, False, True), (False, False, True, False, False), (False, False, False, True, False), (False, False, True, False, True)]
    j = spark.sql("select array('a','b') a, array('b','c','d') b, cast(array() as array<string>) e").select(X.jaccard(F.col("a"), F.col("b")), X.jaccard(F.col("e"), F.col("e"))).first()
    assert tuple(j) == (0.25, 0.0)


@pytest.mark.parametrize(
    ("a", "b", "strict", "aware"),
    [("80 Lakhs", "80 lakhs.", True, True), ("80 lakhs", "8,000,000", False, True), ("40-45 lakhs", "40 to 45 lakhs", False, False), ("around 40 l", "~40 lakh", False, True), ("40 lakhs", "around 40 lakhs", False, False), ("1.2 cr", "120 lakhs", False, True), ("near school", "Near  School!", True, True)],
)
def test_values(a, b, strict, aware):
    assert V.agree(a, b) is strict and V.agree(a, b, "number_aware") is aware
    with pytest.raises(ValueError):
        V.agree(a, b, "other")


def test_shared_magnitude():
    assert V.numbers("40 - 45 lakhs") == ([4_000_000.0, 4_500_000.0], False, []) and V.numbers("none") is None

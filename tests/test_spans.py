from pyspark.sql import functions as F

from talkmill.functions import spans as S
from talkmill.operators import scrub as R


def cats(text, **k):
    return sorted((text[a:b], c) for a, b, c, _ in S.all_spans(text, **k))


def test_finders():
    assert cats("mail a.b@x.example or pay me@upi") == [("a.b@x.example", "EMAIL"), ("me@upi", "UPI")]
    assert ("HDFC0001234", "IFSC") in cats("code HDFC0001234")
    assert ("AB12345678", "TXNREF") in cats("UTR no: AB12345678") and ("material", "TXNREF") in cats("reference material")
    assert ("4111 1111 1111 1111", "CARD") in cats("card 4111 1111 1111 1111")
    assert ("123456789012345", "ACCOUNT") in cats("use 123456789012345") and ("123456789", "ACCOUNT") in cats("a/c 123456789") and not cats("order 123456789")
    assert cats("+91 98765 43210") == [("+91 98765 43210", "PHONE")] and cats("9876543210") == [("9876543210", "PHONE")]
    assert cats("₹80 lakhs and 40k, 50") == [("40k", "AMOUNT"), ("₹80 lakhs", "AMOUNT")]
    assert cats("Flat 402, Sai Residency 500032") == [("402", "ADDRESS"), ("500032", "ADDRESS")] and cats("flat near the lake") == []
    assert cats("at MG road, ok", by_keyword=True) == [("road", "ADDRESS")]
    assert cats("Priya sharma said priya", roster=["Priya Sharma", " "]) == [("Priya sharma", "PERSON"), ("priya", "PERSON")]
    assert cats("call +44 20 7946 0958 now") == [("+44 20 7946 0958", "PHONE")] and cats("44 20 7946 0958") == [("44 20 7946 0958", "ACCOUNT")]
    assert cats("+4111 1111 1111 111") == [("+4111 1111 1111 111", "PHONE")] and cats("91 98765 43210 in a/c") == [("91 98765 43210", "PHONE")]
    assert cats("plot 17, near main road; ok", by_keyword=True) == [("17", "ADDRESS"), ("main road", "ADDRESS"), ("plot 17", "ADDRESS"), ("road", "ADDRESS")]
    assert cats("") == [] and cats(None) == []


def clean(spark, *texts):
    df = spark.createDataFrame([("c", k, t) for k, t in enumerate(texts)], "conversation string, turn int, text string")
    out, audit = R.scrub(df)
    return [r.clean for r in out.orderBy("turn").collect()], audit


def test_scrub(spark):
    texts = ["call 9876543210 or +91 98765 43210", "a/c 123456789012 has 40k", "budget 40 lakhs", None, "", "mail Xa@Yo.example, xa@yo.example then 9876543210", "x" * 50_000 + " 9876543210"]
    out, audit = clean(spark, *texts)
    assert out[0] == "call [PHONE_1] or [PHONE_1]" and out[1] == "a/c [ACCOUNT_1] has [AMOUNT_1]" and out[2] == "budget 40 lakhs" and out[3] is None and out[4] == ""
    assert out[5] == "mail [EMAIL_1], [EMAIL_1] then [PHONE_1]" and out[6].endswith(" [PHONE_1]")
    got = {r.category: (r.replacements, r.entities) for r in R.replacement_counts(audit).collect()}
    assert got == {"PHONE": (4, 1), "ACCOUNT": (1, 1), "AMOUNT": (1, 1), "EMAIL": (2, 1)}
    assert clean(spark)[0] == []


def test_overlaps_are_greedy(spark):
    rows = [[(0, 10, "PHONE"), (5, 12, "EMAIL"), (11, 20, "ADDRESS")], [(0, 5, "ADDRESS"), (0, 9, "ADDRESS"), (9, 12, "ADDRESS")]]
    df = spark.createDataFrame([(k, [(a, b, c, None) for a, b, c in r]) for k, r in enumerate(rows)], f"k int, s {S.SPANS}")
    got = [[(x["first"], x["end"]) for x in r[0]] for r in df.orderBy("k").select(S.resolved(F.col("s"))).collect()]
    assert got == [[(5, 12)], [(0, 9), (9, 12)]]


def test_speakers(spark):
    df = spark.createDataFrame([("c", 1, "B", "agent"), ("c", 0, "A", None), ("c", 2, "A", None), ("d", 0, "A", None), ("c", 3, None, "x")], "conversation string, turn int, speaker string, role string")
    roles = spark.createDataFrame([("A", "customer")], "speaker string, role string")
    assert sorted(map(tuple, R.speakers(df, roles).collect())) == [("c", "A", "SPEAKER_1", "customer"), ("c", "B", "SPEAKER_2", "agent"), ("d", "A", "SPEAKER_1", "customer")]
    assert {r.role for r in R.speakers(df).collect()} == {"unknown", "agent"}


def test_speakers_are_scrubbed(spark):
    rows = [("c", 1, "Priya Sharma", "hi, Ravi here? call 9876543210"), ("c", 2, " ravi ", "yes PRIYA, sharma.x@y.example and Priya sharma"), ("c", 3, None, "mail Priya Sharma@yo.example"), ("d", 1, "Ravi", "Priya and Ravi"), ("d", 2, " ", None)]
    df = spark.createDataFrame(rows, "conversation string, turn int, speaker string, text string")
    out, audit = R.scrub(df, people=R.rosters(df))
    got = {(r.conversation, r.turn): r.clean for r in out.collect()}
    assert got["c", 1] == "hi, [PERSON_2] here? call [PHONE_1]" and got["c", 2] == "yes [PERSON_1], [EMAIL_1] and [PERSON_1]" and got["c", 3] == "mail [PERSON_1] [EMAIL_2]"
    assert got["d", 1] == "Priya and [PERSON_1]" and got["d", 2] is None
    assert {r.category: (r.replacements, r.entities) for r in R.replacement_counts(audit).collect()} == {"PERSON": (5, 3), "PHONE": (1, 1), "EMAIL": (2, 2)}
    assert R.residual(out, roster="roster").collect() == [] and [tuple(r) for r in R.residual(out, text="text", roster="roster").filter("category = 'PERSON'").collect()] == [("PERSON", 5)]
    assert S.persons("ſam and SAM", ["Sam", "Sam Lee"]) == [(0, 3, "PERSON", "Sam Lee"), (8, 11, "PERSON", "Sam Lee")]


def test_scrub_queries_know_the_speakers(spark, tmp_path):
    from talkmill.plans import privacy

    spark.createDataFrame([(1, "c", "Priya", None, "I am priya")], "message_id long, source_conversation_id string, speaker string, role string, text string").write.parquet(f"{tmp_path}/messages.parquet")
    assert [tuple(r) for r in privacy.pi11_scrubbed(spark, str(tmp_path)).collect()] == [(1, "I am [PERSON_1]")]
    assert [tuple(r) for r in privacy.ag20_replacements(spark, str(tmp_path)).collect()] == [("PERSON", 1, 1)] and privacy.ag20_residual(spark, str(tmp_path)).collect() == []


def test_scrub_queries_read_every_message(spark, tmp_path):
    from talkmill.plans import privacy

    rows = [(1, None, "Priya", None, "priya: 9876543210"), (2, None, "Ravi", None, "Priya: 9876543211"), (3, "c", "Ravi", None, None), (4, "c", "Priya", None, "ravi"), (5, "", None, None, "xa@yo.example")]
    spark.createDataFrame(rows, "message_id long, source_conversation_id string, speaker string, role string, text string").write.parquet(f"{tmp_path}/messages.parquet")
    got = dict(map(tuple, privacy.pi11_scrubbed(spark, str(tmp_path)).collect()))
    assert got == {1: "[PERSON_1]: [PHONE_1]", 2: "Priya: [PHONE_1]", 3: None, 4: "[PERSON_1]", 5: "[EMAIL_1]"}
    assert {r[0]: (r[1], r[2]) for r in privacy.ag20_replacements(spark, str(tmp_path)).collect()} == {"PERSON": (2, 2), "PHONE": (2, 2), "EMAIL": (1, 1)}
    assert sorted(tuple(r) for r in privacy.pi13_speakers(spark, str(tmp_path)).collect()) == [("c", "Priya", "SPEAKER_1", "unknown")]

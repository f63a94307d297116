import numpy as np

from talkmill.llm import language as K

TEXTS = {
    "en": "could you please send me the price of the house near the school", "hi": "मुझे इस घर की कीमत बताइए और कल मिलना है", "mr": "मला या घराची किंमत सांगा आणि उद्या भेटू आहे", "te": "నాకు ఈ ఇంటి ధర చెప్పండి రేపు కలుద్దాం",
    "es": "quiero saber el precio de la casa y cuándo podemos visitarla con mis padres", "pt": "não sei o preço da casa e quando podemos fazer a visita com os meus pais", "de": "ich möchte den Preis für das Haus wissen und wann wir es sehen können",
}


def langs(texts, model):
    return [[s[0] for s in K.segments(*x)] for x in K.label_words(texts, model)]


def test_seed_alone_tells_languages():
    model = K.Scores(K.seed_counts())
    assert langs(list(TEXTS.values()), model) == [[k] for k in TEXTS]
    assert langs(["mujhe ghar chahiye lekin daam zyada hai bhai"], model) == [["hi"]]
    assert langs([TEXTS["en"] + ". " + TEXTS["de"], TEXTS["hi"] + "\n" + TEXTS["es"]], model) == [["en", "de"], ["hi", "es"]]
    assert langs([None, "", "  ", "123 456 @@ 55", "a@b.example +91 555"], model) == [[], [], [], [], []]


def test_batches_are_as_single_texts():
    model, rnd = K.Scores(K.seed_counts()), np.random.default_rng(5)
    words = [w for t in TEXTS.values() for w in t.split()] + ["|", "-", "12", "a@b.example", "x,", "so.", "Qwrtz"]
    texts = [None, "", "  \n ", *(sep.join(rnd.choice(words, int(rnd.integers(1, 40)))) for sep in (" ", "\n", "  ", " \n\t ") for _ in range(60)), *TEXTS.values(), ". ".join(TEXTS.values()), "\n".join(TEXTS.values()) + "\n"]
    offsets, cols = K.batch_segments(texts, model)
    for k, plain in enumerate(K.segments(*x) for x in K.label_words(texts, model)):
        got = [(K.LANGUAGES[a], *b) for a, *b in zip(*(c[offsets[k] : offsets[k + 1]].tolist() for c in cols))]
        assert [g[:4] for g in got] == [p[:4] for p in plain] and np.allclose([g[4] for g in got], [p[4] for p in plain])
    assert K.batch_segments([], model)[0].tolist() == [0] and K.batch_segments([None, ""], model)[0].tolist() == [0, 0, 0]


def test_spans_of_mixed_texts():
    """Joined clauses of known languages: the spans found against where they were joined."""
    model, rnd, right, all_ = K.Scores(K.seed_counts()), np.random.default_rng(9), 0, 0
    names = list(TEXTS)
    for _ in range(120):
        a, b = rnd.choice(names, 2, replace=False)
        text = f"{TEXTS[a]}. {TEXTS[b]}"
        want = [(a, 0, len(TEXTS[a]) + 1), (b, len(TEXTS[a]) + 2, len(text))]
        got = [s[:3] for s in K.segments(*K.label_words([text], model)[0])]
        right += len({*got} & {*want})
        all_ += 2
    print(f"spans right: {right / all_:.3f}")
    assert right / all_ >= 0.9


def test_viterbi_is_the_best_path():
    from itertools import product

    rnd = np.random.default_rng(3)
    for _ in range(20):
        n = int(rnd.integers(1, 5))
        s, clause = -rnd.random((1, n, K.K)) * 8, rnd.random((1, n)) < 0.4
        got = K.viterbi(np.array([n]), s, clause)[0]

        def cost(path):
            return sum(s[0, k, x] for k, x in enumerate(path)) - sum((K.SWITCH_AT_CLAUSE if clause[0, k] else K.SWITCH) for k in range(1, n) if path[k] != path[k - 1])

        assert abs(cost(got) - max(cost(p) for p in product(range(K.K), repeat=n))) < 1e-9


def test_table(spark):
    rows = [(1, TEXTS["en"], "English"), (2, TEXTS["en"], "de"), (3, TEXTS["de"], None), (4, TEXTS["es"] + ". " + TEXTS["en"], "es"), (5, None, "en"), (6, "", None), (7, "hola casa", None), (8, TEXTS["te"], " TE "), (9, TEXTS["en"] + " " + TEXTS["en"] * 2000, "en"), (10, TEXTS["pt"], "??"), (10, TEXTS["pt"], "??")]
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "turn_id long, text string, language string, _label string, segments int")
    codes = spark.createDataFrame([("en", "en"), ("English", "en"), ("de", "de"), ("te", "te"), ("es", "es"), (None, "en")], "spelling string, lang string")
    found = K.identified(df, codes)
    assert sorted(map(tuple, K.mislabelled(found).collect())) == [(2, "en"), (3, "de"), (4, "en"), (4, "es"), (10, "pt"), (10, "pt")]
    assert all(r.confidence is None or 0 <= r.confidence <= 1 for r in found.collect())
    assert K.mislabelled(K.identified(df.limit(0), codes.limit(0))).count() == 0

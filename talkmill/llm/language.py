"""Language of texts and of the segments of mixed texts.

Each word has a score for each language: candidates are narrowed by the script of its letters, then scored by how often the
word (or, if unknown, its character trigrams) occurs in the language. Viterbi over the words of a text, with a penalty for
switching that is smaller at the end of a clause, labels spans. Words that tell nothing (numbers, contact details, signs,
names unlike any language) score alike in all languages.

The scores come from a small seed of ordinary sentences and from a sample of labelled rows: at most LABELLED_ROWS, those with
the smallest hashes. As labels are partly wrong and texts mixed, the sample is then relabelled by the fitted scores
(ROUNDS times), a span keeping its row's label unless the scores say otherwise.

Defined results: null, empty and blank texts have no segment; texts without telling words have none either; labels are
compared exactly, then without case and outer blanks, with the catalog of spellings; a missing label is never right.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.common import bounded_broadcast, spread, table, trimmed
from talkmill.llm.language_seed import SEED

LANGUAGES = ("en", "hi", "mr", "te", "es", "pt", "de")
LABELLED_ROWS, ROUNDS = 8_000, 2
SWITCH, SWITCH_AT_CLAUSE, FLOOR = 9.0, 4.0, -6.0
CLAUSE_WORDS, ALONE_WORDS = 3, 1  # telling words of a segment beside others, and of one that is alone
MIN_WORDS = 4
CONFIDENT = 0.8  # a segment beside others needs this confidence; words of a name alone do not reach it

# fixed values: Unicode blocks and the languages written in them
SCRIPTS = (("ऀ", "ॿ", ("hi", "mr")), ("ఀ", "౿", ("te",)))
LATIN = ("en", "hi", "es", "pt", "de")
_WORD = re.compile(r"\S+")
_CORE = re.compile(r"[^\W\d_](?:[^\W\d_]|[ऀ-ॣఀ-౥‌‍'’])*")
_CONTACT = re.compile(r"@|\(at\)|\[at\]|://|\d")
_CLAUSE_END = re.compile(r"[,.;:!?।|/—–)\-]$")
BETWEEN = ("|", "/", "—", "-", "–")
REMEMBER = 300_000
K = len(LANGUAGES)
INDEX = {x: k for k, x in enumerate(LANGUAGES)}


def candidates(word: str) -> tuple[str, ...]:
    for lo, hi, langs in SCRIPTS:
        if any(lo <= ch <= hi for ch in word):
            return langs
    return LATIN if any("a" <= ch <= "z" or "À" <= ch <= "ɏ" for ch in word) else ()


def core(token: str) -> str:
    """The lower-case letters of a token that can tell its language, '' if none can."""
    if _CONTACT.search(token):
        return ""
    m = _CORE.search(token)
    return m.group().lower().strip("'’‌‍") if m else ""


class Scores:
    """Word and trigram counts by language, as relative log scores."""

    def __init__(self, words: dict[str, np.ndarray]):
        self.words = {w: c for w, c in words.items() if c.sum() > 0}
        total = sum(self.words.values(), np.zeros(K)) + 1.0
        self.total = total
        grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(K))
        for w, c in self.words.items():
            for g in self._grams(w):
                grams[g] += np.minimum(c, 3.0)
        self.grams = dict(grams)
        self.gram_total = sum(self.grams.values(), np.zeros(K)) + 1.0
        self.forget()

    def forget(self) -> None:
        """Drop what is known of tokens met. Only ever a matter of speed, but rows of the matrix must not outlive it."""
        self.tokens: dict[str, int] = {}  # token as it stands -> 4 x row + 2 x (is a sign between clauses) + (ends a clause)
        self.rows: dict[str, int] = {}  # word -> row
        self.matrix = np.zeros((1024, K))

    @staticmethod
    def _grams(w: str) -> list[str]:
        w = f"^{w}$"
        return [w[k : k + 3] for k in range(len(w) - 2)]

    def row(self, word: str) -> int:
        """Where the scores of a word stand: relative to the best language, 0 for all if the word tells nothing."""
        k = self.rows.get(word)
        if k is None:
            k = self.rows[word] = len(self.rows)
            if k == len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[k] = self._score(word)
        return k

    def code(self, token: str) -> int:
        got = self.tokens[token] = 4 * self.row(core(token)) + 2 * (token in BETWEEN) + bool(_CLAUSE_END.search(token))
        return got

    def _score(self, word: str) -> np.ndarray:
        langs = candidates(word) if word else ()
        if not langs:
            return np.zeros(K)
        allowed = np.array([x in langs for x in LANGUAGES])
        c = self.words.get(word)
        if c is not None and (c * allowed).sum() > 0:
            s = np.log((c + 0.05) / self.total)
        else:
            s = np.zeros(K)
            gs = self._grams(word)
            for g in gs:
                s += np.log((self.grams.get(g, 0) + 0.3) / self.gram_total)
            s *= 1.5 / max(len(gs), 3)
        s = np.where(allowed, s, -np.inf)
        s = np.maximum(s - s.max(), FLOOR)
        return np.where(allowed, s, FLOOR)


def viterbi(lengths: np.ndarray, scores: np.ndarray, clause: np.ndarray) -> np.ndarray:
    """Language of each word. scores: texts x words x languages (padded), clause: whether the word before ended a clause."""
    n, width, _ = scores.shape
    back = np.zeros((n, width, K), np.int8)
    cost = scores[:, 0].copy()
    order = np.arange(K)
    final = np.where((lengths == 1)[:, None], cost, 0.0)
    for p in range(1, width):
        pen = np.where(clause[:, p], SWITCH_AT_CLAUSE, SWITCH)[:, None]
        best = cost.argmax(axis=1)
        change = cost[np.arange(n), best][:, None] - pen
        stay = cost >= change
        back[:, p] = np.where(stay, order, best[:, None])
        cost = np.where(stay, cost, change) + scores[:, p]
        last = lengths == p + 1
        final[last] = cost[last]
    out = np.zeros((n, width), np.int8)
    state = final.argmax(axis=1)
    for p in range(width - 1, -1, -1):
        live = lengths > p
        out[live, p] = state[live]
        if p:
            state = np.where(live, back[np.arange(n), p, state], state)
    return out


def _tokens(text: str | None) -> list[re.Match]:
    return list(_WORD.finditer(text)) if text else []


class Coded:
    """Texts as one run of tokens: how many each has, where it starts, the row of each token's scores, and whether a clause ended before it."""

    def __init__(self, texts: list[str | None], model: Scores):
        if len(model.tokens) > REMEMBER:
            model.forget()
        get, code = model.tokens.get, model.code
        codes: list[int] = []
        lengths, line = np.zeros(len(texts), np.int64), []
        for k, t in enumerate(texts):
            if t:
                first = len(codes)
                if "\n" in t:
                    for part in t.split("\n"):
                        if len(codes) > first:
                            line.append(len(codes))
                        codes += [c if (c := get(w)) is not None else code(w) for w in part.split()]
                else:
                    codes += [c if (c := get(w)) is not None else code(w) for w in t.split()]
                lengths[k] = len(codes) - first
        flat = np.array(codes, np.int64)
        self.lengths, self.start = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        self.rows = flat >> 2
        self.clause = (flat & 2) > 0
        self.clause[1:] |= (flat[:-1] & 1) > 0
        self.clause[[x for x in line if x < len(flat)]] = True
        self.clause[self.start[lengths > 0]] = False

    def languages(self, model: Scores) -> np.ndarray:
        """The language of each token. Texts of like length are decoded together."""
        langs = np.zeros(len(self.rows), np.int8)
        order = np.argsort(self.lengths, kind="stable")
        order = order[self.lengths[order] > 0]
        sizes = self.lengths[order]
        i = 0
        while i < len(order):
            longest = max(int(sizes[i]) * 2, 8)
            j = max(i + 1, int(np.searchsorted(sizes, longest, side="right")))
            while j > i + 1 and (j - i) * int(sizes[j - 1]) > 200_000:
                j = i + (j - i) // 2
            part = order[i:j]
            n, width = self.lengths[part], int(sizes[j - 1])
            place = np.arange(width)
            inside = place < n[:, None]
            at = np.where(inside, self.start[part][:, None] + place, 0)
            got = viterbi(n, model.matrix[self.rows[at]], self.clause[at])
            langs[at[inside]] = got[inside]
            i = j
        return langs


def label_words(texts: list[str | None], model: Scores) -> list[tuple[list[re.Match], np.ndarray, np.ndarray]]:
    """Tokens, their scores and their languages, for each text."""
    c = Coded(texts, model)
    langs = c.languages(model)
    return [(_tokens(t), model.matrix[c.rows[a : a + n]], langs[a : a + n]) for t, a, n in zip(texts, c.start.tolist(), c.lengths.tolist())]


def batch_segments(texts: list[str | None], model: Scores) -> tuple[np.ndarray, list[np.ndarray]]:
    """List offsets, and the columns of `segments`, for a batch of texts."""
    c = Coded(texts, model)
    langs = c.languages(model)
    of = np.repeat(np.arange(len(texts)), c.lengths)
    edge = np.flatnonzero(np.concatenate([[True], (langs[1:] != langs[:-1]) | (of[1:] != of[:-1])])) if len(langs) else np.zeros(0, np.int64)
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
    if not len(edge):
        return np.zeros(len(texts) + 1, np.int64), none
    scores = model.matrix[c.rows]
    text, lang, end = of[edge], langs[edge], np.concatenate([edge[1:], [len(langs)]])
    sums = np.add.reduceat(scores, edge, axis=0)
    words = np.add.reduceat((scores.min(axis=1) < -0.5).astype(np.int64), edge)
    p = np.exp(sums - sums.max(axis=1, keepdims=True))
    sure = p[np.arange(len(edge)), lang] / p.sum(axis=1)
    alone = np.bincount(text, minlength=len(texts))[text] == 1
    keep = np.where(alone, words >= ALONE_WORDS, (words >= CLAUSE_WORDS) & (sure >= CONFIDENT))
    left = np.bincount(text[keep], minlength=len(texts)) == 0  # texts of which nothing is kept: the segment of most words
    order = np.lexsort((edge, -words, text))
    best = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
    best = best[left[text[best]] & (words[best] >= ALONE_WORDS)]
    keep[best] = True
    pick = np.flatnonzero(keep)
    first, last = edge[pick] - c.start[text[pick]], end[pick] - c.start[text[pick]]
    a, b = np.zeros(len(pick), np.int64), np.zeros(len(pick), np.int64)
    for k, (t, i, j) in enumerate(zip(text[pick].tolist(), first.tolist(), last.tolist())):
        s = texts[t]
        if i == 0 and j == c.lengths[t]:
            a[k], b[k] = len(s) - len(s.lstrip()), len(s.rstrip())
        else:
            spans = [m.span() for m in _WORD.finditer(s)]
            a[k], b[k] = spans[i][0], spans[j - 1][1]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text[pick], minlength=len(texts)))])
    return offsets, [lang[pick], a, b, words[pick], sure[pick]]


def segments(tokens: list[re.Match], scores: np.ndarray, langs: np.ndarray) -> list[tuple[str, int, int, int, float]]:
    """(language, first character, end, telling words, confidence) of each span that holds enough telling words."""
    if not len(langs):
        return []
    edge = np.flatnonzero(np.concatenate([[True], langs[1:] != langs[:-1], [True]]))
    found = []
    for a, b in zip(edge, edge[1:]):
        s = scores[a:b]
        tells = s.min(axis=1) < -0.5
        sums = s.sum(axis=0)
        p = np.exp(sums - sums.max())
        found.append((LANGUAGES[langs[a]], tokens[a].start(), tokens[b - 1].end(), int(tells.sum()), float(p[langs[a]] / p.sum())))
    least = ALONE_WORDS if len(found) == 1 else CLAUSE_WORDS
    kept = [f for f in found if f[3] >= least and (len(found) == 1 or f[4] >= CONFIDENT)]
    if not kept and found:
        best = max(found, key=lambda f: f[3])
        kept = [best] if best[3] >= ALONE_WORDS else []
    return kept


def seed_counts() -> dict[str, np.ndarray]:
    words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(K))
    for lang, lines in SEED.items():
        for line in lines:
            for t in _tokens(line):
                if (w := core(t.group())) and lang in candidates(w):
                    words[w][INDEX[lang]] += 1.0
    return words


def fit(rows: list[tuple[str, str | None]]) -> Scores:
    """Scores from the seed and (text, language or None) rows."""
    texts = Counter((t, lang) for t, lang in rows if t)
    pairs = list(texts.items())
    words = seed_counts()
    for (t, lang), n in pairs:
        if lang in INDEX:
            for m in _tokens(t):
                if (w := core(m.group())) and lang in candidates(w):
                    words[w][INDEX[lang]] += n
    model = Scores(words)
    for _ in range(ROUNDS):
        again = seed_counts()
        for ((_, lang), n), (toks, _, langs) in zip(pairs, label_words([t for (t, _), _ in pairs], model)):
            for m, k in zip(toks, langs):
                if (w := core(m.group())) and LANGUAGES[k] in candidates(w):
                    again[w][k] += n
        model = Scores(again)
    return model


def label_map(codes: DataFrame) -> DataFrame:
    """Spelling (trimmed, lower case) -> language; spellings that mean several languages mean none."""
    c = codes.select(F.lower(trimmed("spelling")).alias("_spelling"), F.col("lang").alias("_label")).filter("_spelling is not null")
    return c.groupBy("_spelling").agg(F.min("_label").alias("_label"), F.count_distinct("_label").alias("_k")).filter("_k = 1").drop("_k")


def with_label(rows: DataFrame, codes: DataFrame, label: str) -> DataFrame:
    return rows.withColumn("_spelling", F.lower(trimmed(label))).join(bounded_broadcast(label_map(codes)), "_spelling", "left").drop("_spelling")


def train(rows: DataFrame, *, text: str = "text") -> Scores:
    """`rows` with `_label`. The sample is the rows whose text hashes are smallest, so it is the same however rows are laid out."""
    held = rows.filter(F.col(text).isNotNull() & F.col("_label").isNotNull()).select(F.col(text).alias("t"), F.col("_label").alias("l")).orderBy(F.xxhash64("t"), "t", "l").limit(LABELLED_ROWS).collect()
    return fit([(r.t, r.l) for r in held])


SEGMENTS = "array<struct<lang:string,first:int,end:int,words:int,confidence:double>>"


def segmenter(spark, model: Scores):
    """A function Column -> Column of segments. The model (some thousand words) goes to each executor once."""
    held = spark.sparkContext.broadcast((model.words,))
    made: list[Scores] = []

    def cut(text: pa.Array) -> pa.Array:
        if not made:
            made.append(Scores(held.value[0]))
        once = text.dictionary_encode()  # chats repeat themselves: a text is looked at once in a batch
        offsets, cols = batch_segments(once.dictionary.to_pylist(), made[0])
        names, types = pa.array(LANGUAGES, pa.string()), (pa.int32(), pa.int32(), pa.int32(), pa.float64())
        flat = pa.StructArray.from_arrays([names.take(pa.array(cols[0], pa.int8())), *[pa.array(c, t) for c, t in zip(cols[1:], types)]], ["lang", "first", "end", "words", "confidence"])
        found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
        nothing = pa.array([[]], found.type)
        return pa.concat_arrays([found, nothing]).take(once.indices.fill_null(len(found)))

    cut.__annotations__ = {"text": pa.Array, "return": pa.Array}
    run = F.arrow_udf(cut, SEGMENTS).asNondeterministic()  # else each column made of it would run it again
    return lambda c: run(c)


def identified(rows: DataFrame, codes: DataFrame, *, key: str = "turn_id", text: str = "text", label: str = "language") -> DataFrame:
    """(key, label, n_words, segments, lang, confidence): lang is that of most words, confidence that of its segments by words."""
    own = with_label(spread(rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(label).alias("_lab"))), codes, "_lab")
    model = train(own, text="_text")
    cut = segmenter(rows.sparkSession, model)
    words = F.regexp_count(F.coalesce("_text", F.lit("")), F.lit(r"[^\s]+"))
    out = own.select(F.col("_key").alias(key), F.col("_label").alias("label"), words.alias("n_words"), cut(F.col("_text")).alias("segments"))
    best: Column = F.array_max(F.transform("segments", lambda s: F.struct(s["words"], s["confidence"], s["lang"])))
    return out.withColumn("lang", best["lang"]).withColumn("confidence", best["confidence"])


def mislabelled(found: DataFrame, *, key: str = "turn_id") -> DataFrame:
    """(key, lang) for rows of at least MIN_WORDS words whose text isn't exactly in the one language of the label."""
    langs = found.filter(F.col("n_words") >= MIN_WORDS).select(key, "label", F.array_distinct(F.transform("segments", lambda s: s["lang"])).alias("langs"))
    right = (F.size("langs") == 1) & F.col("label").isNotNull() & (F.col("langs")[0] == F.col("label"))
    return langs.filter(~right).select(key, F.explode("langs").alias("lang"))


def _syn(spark, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "syn_020"), table(spark, sf_dir, "language_codes"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return mislabelled(_syn(spark, sf_dir))


def p4_segments(spark, sf_dir: str) -> DataFrame:
    found = _syn(spark, sf_dir).select("turn_id", "lang", "confidence", F.posexplode_outer("segments").alias("place", "s"))
    return found.select("turn_id", "lang", "confidence", "place", F.col("s.lang").alias("segment_lang"), F.col("s.confidence").alias("segment_confidence"), F.col("s.first").alias("first_char"), F.col("s.end").alias("end_char"))

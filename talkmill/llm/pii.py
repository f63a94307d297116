"""Personal information in free text: a linear-chain conditional random field over word shapes.

Features of a token: the words within REACH places (those of the carrier sentences of the labelled table; all others are one
unknown word), the shapes within NEAR places (letter case, script, length of a digit run, sign, whether blanks precede, whether
the name list holds it) and the pairs of neighbouring shapes. Labels are begin and inside of each kind, and outside.

Training is full-batch on the table of `pii_examples` by a limited-memory quasi-Newton method, once in a driver process.
Decoding is Viterbi in numpy over batches: a distinct token is looked at once, what it adds to each label at each place is a
row of a table, and texts of like length are decoded together, whatever their length. A worker remembers results of texts it
has met, as chats repeat themselves. After decoding, exact checks drop spans that cannot be of their kind (a phone without
enough digits, a mail without a host); nothing is added beside the decoder.

Defined results: null, empty and blank texts hold nothing and stay as they are; repeated rows come out alike; a kind is listed
once for a row; extra columns are not looked at.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.common import lookup_rows, spread, table
from talkmill.llm.pii_examples import examples

KINDS = ("email", "phone", "id_number", "address", "person")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N = len(LABELS)
REACH, NEAR = 4, 2
EXAMPLES, L2, STEPS = 2600, 0.02, 75
PAIRS = 1 << 12
REMEMBER = 300_000
TOKEN = re.compile(r"[^\S\n]*(?:[^\W\d_](?:[^\W\d_]|[ऀ-ॣఀ-౥‌‍̀-ͯ])*|\d+|[^\s])|[^\S\n]*\n")
BAD = -1e4


def shape_of(token: str, listed: frozenset[str]) -> str:
    """The shape of a token as cut from a text, with the blanks before it."""
    bare = token.lstrip(" \t\r\f\v\xa0   ")
    gap = "_" if len(bare) < len(token) else ""
    if bare == "\n":
        return "\n"
    if bare[:1].isdigit():
        return f"{gap}9{min(len(bare), 15)}{'z' if bare[0] == '0' else ''}{'' if bare.isascii() else 'u'}"
    if not (bare[:1].isalpha()):
        return gap + (bare if bare.isascii() else "s")
    form = "i" if "ऀ" <= bare[0] <= "෿" else "a" if len(bare) == 1 and bare.isupper() else "A" if bare.isupper() else "Aa" if bare[0].isupper() else "a1" if len(bare) == 1 else "aa"
    if form == "A":
        form += str(min(len(bare), 7))
    return gap + form + ("*" if bare.lower() in listed else "")


def word_of(token: str) -> str:
    bare = token.strip().lower()
    return "9" * min(len(bare), 3) if bare[:1].isdigit() else bare or "\n"


class Coded:
    """Texts as rows of word and shape numbers, with REACH empty places between texts; number 0 is the empty place."""

    def __init__(self, lengths: np.ndarray, words: np.ndarray, shapes: np.ndarray):
        self.lengths = lengths
        self.start = REACH + np.concatenate([[0], np.cumsum(lengths[:-1] + REACH)]) if len(lengths) else np.zeros(0, np.int64)
        size = int(lengths.sum() + REACH * (len(lengths) + 1))
        self.at = np.arange(int(lengths.sum())) + REACH * (1 + np.repeat(np.arange(len(lengths)), lengths))
        self.words, self.shapes = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.words[self.at], self.shapes[self.at] = words, shapes


class Tagger:
    def __init__(self, listed: frozenset[str]):
        self.listed = listed
        self.word_ids: dict[str, int] = {}
        self.shape_ids: dict[str, int] = {}
        self.tokens: dict[str, tuple[int, int]] = {}
        self.memory: dict[str, tuple] = {}

    # -- coding -------------------------------------------------------------------------------------------------
    def code(self, token: str) -> tuple[int, int]:
        got = self.tokens.get(token)
        if got is None:
            if len(self.tokens) > REMEMBER:
                self.tokens.clear()
            shape = shape_of(token, self.listed)
            got = self.tokens[token] = (self.word_ids.get(word_of(token), 1), self.shape_ids.get(shape) or self.shape_ids.get(shape.replace("u", "").rstrip("*")) or 1)
        return got

    def coded(self, tokens: list[list[str]]) -> Coded:
        code = self.code
        both = np.array([code(t) for ts in tokens for t in ts], np.int32).reshape(-1, 2)
        return Coded(np.array([len(ts) for ts in tokens], np.int64), both[:, 0], both[:, 1])

    def emissions(self, c: Coded) -> np.ndarray:
        """tokens x labels."""
        at = c.at
        e = self.shape_w[NEAR][c.shapes[at]]
        for o in range(-REACH, REACH + 1):
            e = e + self.word_w[o + REACH][c.words[at + o]]
        for o in range(-NEAR, NEAR + 1):
            if o:
                e += self.shape_w[o + NEAR][c.shapes[at + o]]
        for o in (0, 1):
            e += self.pair_w[o][self.pair(c, at, o)]
        return e

    @staticmethod
    def pair(c: Coded, at: np.ndarray, o: int) -> np.ndarray:
        return (c.shapes[at - 1 + o].astype(np.int64) * 1009 + c.shapes[at + o]) % PAIRS

    # -- training -----------------------------------------------------------------------------------------------
    def train(self, rows: list[tuple[str, list[tuple[int, int, str]]]], listed: set[str]) -> None:
        own, self.listed = self.listed, frozenset(listed)
        cut, gold = [], []
        for text, spans in sorted(rows, key=lambda r: -len(TOKEN.findall(r[0]))):
            ms = list(TOKEN.finditer(text))
            cut.append([m.group() for m in ms])
            y = np.zeros(len(ms), np.int64)
            for a, b, kind in spans:
                first = True
                for k, m in enumerate(ms):
                    s = m.end() - len(m.group().lstrip())
                    if s >= a and m.end() <= b:
                        y[k] = 1 + 2 * KINDS.index(kind) + (0 if first else 1)
                        first = False
            gold.append(y)
        seen: dict[str, int] = {}
        for ts, y in zip(cut, gold):
            for w, k in {(word_of(t), int(k)) for t, k in zip(ts, y)}:
                seen[w] = seen.get(w, 0) + 1
        self.word_ids = {w: k + 2 for k, w in enumerate(sorted(w for w, n in seen.items() if n >= 4))}
        self.shape_ids = {s: k + 2 for k, s in enumerate(sorted({shape_of(t, self.listed) for ts in cut for t in ts}))}
        self.tokens.clear()
        c = self.coded(cut)
        v, s = len(self.word_ids) + 2, len(self.shape_ids) + 2
        sizes = [("word_w", (2 * REACH + 1, v, N)), ("shape_w", (2 * NEAR + 1, s, N)), ("pair_w", (2, PAIRS, N)), ("trans", (N, N))]
        ends = np.cumsum([int(np.prod(z)) for _, z in sizes])

        def unpack(theta: np.ndarray) -> None:
            for (name, z), a, b in zip(sizes, [0, *ends[:-1]], ends):
                setattr(self, name, theta[a:b].reshape(z))

        keys = [("word_w", o + REACH, c.words[c.at + o]) for o in range(-REACH, REACH + 1)] + [("shape_w", o + NEAR, c.shapes[c.at + o]) for o in range(-NEAR, NEAR + 1)] + [("pair_w", o, self.pair(c, c.at, o)) for o in (0, 1)]
        plans = []
        for name, o, key in keys:
            order = np.argsort(key, kind="stable")
            ks = key[order]
            starts = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]]))
            plans.append((name, o, order, starts, ks[starts]))
        y = np.concatenate(gold)
        total, width = len(y), int(c.lengths.max())
        begin = np.concatenate([[0], np.cumsum(c.lengths)[:-1]])
        live = np.searchsorted(-c.lengths, -np.arange(1, width + 1), side="right")  # texts longer than each place
        places = [begin[: live[p]] + p for p in range(width)]
        inner = np.ones(total, bool)
        inner[begin] = False
        onehot = np.eye(N)[y]
        ytrans = np.zeros((N, N))
        np.add.at(ytrans, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)

        def objective(theta: np.ndarray) -> tuple[float, np.ndarray]:
            unpack(theta)
            e = self.emissions(c)
            t = np.exp(self.trans)
            top = e.max(axis=1)
            x = np.exp(e - top[:, None])
            alpha, scale, gamma = np.empty((total, N)), np.empty(total), np.empty((total, N))
            for p, at in enumerate(places):
                a = (alpha[at - 1] @ t) * x[at] if p else x[at] * START
                z = a.sum(axis=1)
                scale[at], alpha[at] = z, a / z[:, None]
            beta, gt = np.ones((len(cut), N)), np.zeros((N, N))
            for p in range(width - 1, -1, -1):
                at, m = places[p], live[p]
                gamma[at] = alpha[at] * beta[:m]
                if p:
                    right = x[at] * beta[:m] / scale[at][:, None]
                    gt += (alpha[at - 1].T @ right) * t
                    beta[:m] = right @ t.T
            loglik = -(np.log(scale) + top).sum() + e[np.arange(total), y].sum() + (self.trans * ytrans).sum()
            r = onehot - gamma
            grad = np.zeros(ends[-1])
            g = {name: grad[a:b].reshape(z) for (name, z), a, b in zip(sizes, [0, *ends[:-1]], ends)}
            for name, o, order, starts, ks in plans:
                g[name][o][ks] += np.add.reduceat(r[order], starts, axis=0)
            g["trans"] += ytrans - gt
            return -loglik + L2 * (theta @ theta), -grad + 2 * L2 * theta

        unpack(minimise(objective, np.zeros(ends[-1]), STEPS))
        for name, _ in sizes:
            setattr(self, name, getattr(self, name).astype(np.float32))
        self.trans = np.where(ALLOWED, self.trans, BAD).astype(np.float32)
        self.listed = own
        self.tokens.clear()

    # -- decoding -----------------------------------------------------------------------------------------------
    def labels(self, tokens: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each text. Texts are taken in falling length, so that those still open are a prefix."""
        order = sorted(range(len(tokens)), key=lambda k: -len(tokens[k]))
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(tokens)
        i = 0
        while i < len(order) and tokens[order[i]]:
            width = len(tokens[order[i]])
            j = i + 1
            while j < len(order) and tokens[order[j]] and 3 * len(tokens[order[j]]) >= width - 12 and (j - i) * width < 400_000:
                j += 1
            part = order[i:j]
            i = j
            c = self.coded([tokens[k] for k in part])
            e = self.emissions(c)
            lengths = c.lengths
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            live = np.searchsorted(-lengths, -np.arange(1, width + 1), side="right")  # texts longer than each place
            back = np.zeros((width, len(part), N), np.int8)
            cost = e[begin] + np.where(START > 0, 0, BAD).astype(np.float32)
            t = np.ascontiguousarray(self.trans.T)  # to, from
            for p in range(1, width):
                m = live[p]
                step = cost[:m, None, :] + t
                back[p, :m] = step.argmax(axis=2)
                cost[:m] = step.max(axis=2) + e[begin[:m] + p]
            state = cost.argmax(axis=1)
            lab = np.zeros((len(part), width), np.int8)
            for p in range(width - 1, -1, -1):
                m = live[p]
                lab[:m, p] = state[:m]
                if p:
                    state[:m] = back[p, np.arange(m), state[:m]]
            for r, k in enumerate(part):
                out[k] = lab[r, : lengths[r]]
        return out

    def spans(self, texts: list[str | None]) -> list[tuple[tuple[int, int, int], ...]]:
        """(kind, first, end) spans of each text."""
        out: list = [()] * len(texts)
        memory, todo = self.memory, {}
        for k, t in enumerate(texts):
            if t:
                got = memory.get(t)
                if got is None:
                    todo.setdefault(t, []).append(k)
                else:
                    out[k] = got
        if len(memory) + len(todo) > REMEMBER:
            memory.clear()
        new = list(todo)
        cut = [TOKEN.findall(t) for t in new]
        for t, tokens, lab in zip(new, cut, self.labels(cut)):
            found = found_spans(t, tokens, lab) if lab.any() else ()
            if len(t) <= 400:
                memory[t] = found
            for k in todo[t]:
                out[k] = found
        return out


START = np.array([0.0 if x[0] == "I" else 1.0 for x in LABELS])
ALLOWED = np.array([[not (b[0] == "I") or a[1:] == b[1:] for b in LABELS] for a in LABELS])


def minimise(f, x: np.ndarray, steps: int, memory: int = 6) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    fx, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ q)
            alphas.append(a)
            q -= a * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(past, reversed(alphas)):
            q += (a - r * (y @ q)) * s
        slope, size = -(g @ q), 1.0 if past else 1 / max(1.0, np.abs(g).max())
        if slope >= 0 or np.abs(g).max() < 0.05:
            break
        while True:
            nx = x - size * q
            nf, ng = f(nx)
            if nf <= fx + 1e-4 * size * slope or size < 1e-6:
                break
            size *= 0.4
        s, y = nx - x, ng - g
        if s @ y > 1e-10:
            past = [*past[-(memory - 1) :], (s, y, 1 / (s @ y))]
        if abs(fx - nf) < 1e-5 * abs(fx):
            x = nx
            break
        x, fx, g = nx, nf, ng
    return x


_NUMBER_WORD = re.compile(r"(?i)\b(?:zero|one|two|three|four|five|six|seven|eight|nine|double|triple)\b")
_MAIL = re.compile(r"(?i)[\w.+-]+\s*(?:@|[\[(]\s*at\s*[\])]|\bat\b)\s*[\w-]+(?:\s*(?:\.|[\[(]\s*dot\s*[\])]|\bdot\b)\s*[\w-]+)+")


def can_be(kind: str, text: str) -> bool:
    """Exact check of a decoded span."""
    digits = sum(ch.isdigit() for ch in text)
    if kind == "email":
        return bool(_MAIL.search(text))
    if kind == "phone":
        return 7 <= digits + len(_NUMBER_WORD.findall(text)) <= 18
    if kind == "id_number":
        return digits >= 4
    if kind == "address":
        return digits >= 1
    return any(ch.isalpha() for ch in text) and digits == 0


def found_spans(text: str, tokens: list[str], lab: np.ndarray) -> tuple[tuple[int, int, int], ...]:
    out, pos, open_ = [], 0, None
    for token, k in zip(tokens, lab.tolist()):
        first = pos + len(token) - len(token.lstrip())
        pos += len(token)
        if k % 2:  # begin
            if open_:
                out.append(open_)
            open_ = ((k - 1) // 2, first, pos)
        elif k:
            open_ = (open_[0], open_[1], pos)
        elif open_:
            out.append(open_)
            open_ = None
    if open_:
        out.append(open_)
    return tuple(s for s in out if can_be(KINDS[s[0]], text[s[1] : s[2]]))


@lru_cache(maxsize=4)
def trained(listed: frozenset[str]) -> Tagger:
    rows, invented = examples(EXAMPLES)
    tagger = Tagger(listed)
    tagger.train(rows, invented)
    return tagger


def name_set(names: DataFrame) -> frozenset[str]:
    return frozenset(r[0].strip().lower() for r in lookup_rows(names.select("name_form").filter("name_form is not null").distinct()))


_HERE: dict[str, Tagger] = {}


def _shared(spark, names: DataFrame):
    """The trained tagger (a few MB) as sent to each executor once."""
    t = trained(name_set(names))
    held = spark.sparkContext.broadcast({k: getattr(t, k) for k in ("listed", "word_ids", "shape_ids", "word_w", "shape_w", "pair_w", "trans")})

    def here() -> Tagger:
        key = str(held.id) if hasattr(held, "id") else str(id(held))
        if key not in _HERE:
            made = Tagger(held.value["listed"])
            made.__dict__.update(held.value)
            _HERE.clear()
            _HERE[key] = made
        return _HERE[key]

    return here


def kind_finder(spark, names: DataFrame):
    """Column of texts -> column of a bit set of KINDS."""
    here = _shared(spark, names)

    def kinds(text: pa.Array) -> pa.Array:
        found = here().spans(text.to_pylist())
        return pa.array([sum({1 << s[0] for s in f}) if f else 0 for f in found], pa.int32())

    kinds.__annotations__ = {"text": pa.Array, "return": pa.Array}
    run = F.arrow_udf(kinds, "int").asNondeterministic()  # else the filter on it would run it twice
    return lambda c: run(c)


def redacted_text(text: str, spans: tuple) -> str:
    """Typed placeholders in place of the spans; the same value gets the same number within a text."""
    numbers: dict[tuple[int, str], int] = {}
    counts = [0] * len(KINDS)
    out, pos = [], 0
    for kind, a, b in spans:
        key = (kind, re.sub(r"\W", "", text[a:b]).casefold())
        if key not in numbers:
            counts[kind] += 1
            numbers[key] = counts[kind]
        out += [text[pos:a], f"[{KINDS[kind].upper()}_{numbers[key]}]"]
        pos = b
    return "".join([*out, text[pos:]])


def redactor(spark, names: DataFrame):
    """Column of texts -> column of the texts with placeholders."""
    here = _shared(spark, names)

    def redact(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        return pa.array([t if not s else redacted_text(t, s) for t, s in zip(texts, here().spans(texts))], pa.string())

    redact.__annotations__ = {"text": pa.Array, "return": pa.Array}
    run = F.arrow_udf(redact, "string")
    return lambda c: run(c)


def _both(spark, sf_dir: str) -> DataFrame:
    pick = lambda name, key: spread(table(spark, sf_dir, name).select(F.lit(name).alias("src"), F.col(key).cast("bigint").alias("row_id"), "text"))
    return pick("messages", "message_id").unionByName(pick("syn_020", "turn_id"))


def kinds_of(rows: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """`rows` without the text, one for each kind that occurs in it."""
    bits: Column = kind_finder(rows.sparkSession, names)(F.col(text))
    held = rows.withColumn("_bits", bits).filter("_bits > 0").drop(text)
    each = F.filter(F.array(*[F.when(F.col("_bits").bitwiseAND(1 << k) > 0, F.lit(x)) for k, x in enumerate(KINDS)]), lambda x: x.isNotNull())
    return held.withColumn("kind", F.explode(each)).drop("_bits")


def p2_found(spark, sf_dir: str) -> DataFrame:
    return kinds_of(_both(spark, sf_dir), table(spark, sf_dir, "name_list"))


def p2_redacted(spark, sf_dir: str) -> DataFrame:
    rows = _both(spark, sf_dir)
    return rows.withColumn("text", redactor(spark, table(spark, sf_dir, "name_list"))(F.col("text")))

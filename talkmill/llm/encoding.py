"""Encoding texts with a public byte-level BPE, by a bounded-lookahead streaming transducer.

In byte-level BPE a token sequence is the encoding of its bytes exactly if every two neighbouring tokens are the encoding of
their joint bytes. So each prefix of a piece has one last token, found from the earlier prefixes; the last tokens form a tree
over positions, and the encoding is the path from the end to the root. A later token begins at most `lookahead` - 1 bytes
before the current end, where `lookahead` is the length of the longest token the merge list makes: so tokens before the
nearest common ancestor of those positions are stable and are emitted at once. What is held is the window and the tokens
after that ancestor.

Decoding is an incremental machine: token bytes go into a UTF-8 decoder that holds only the bytes of an unfinished character.

Defined results: null and empty texts have the empty list; special-token strings in a text are ordinary text; repeated texts
are encoded alike; there is no bound on length.
"""

from __future__ import annotations

import base64
import codecs
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.common import spread, table

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
# fixed value: how the public vocabulary cuts a text into pieces before merging
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# the same for texts of ASCII letters, digits and signs, where the standard library is quicker
_PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_ODD_BLANKS = re.compile("[\x1c-\x1f]")
CACHE = 200_000  # pieces whose ids a worker remembers; only ever a matter of speed


class Transducer:
    """Ranks (bytes -> id, lower ids merge first) as a streaming encoder of pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.lookahead = max(map(len, ranks), default=1)
        lengths: dict[bytes, set[int]] = {}
        for b in ranks:
            lengths.setdefault(b[-2:], set()).add(len(b))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}  # by piece
        self.words: dict[str, list[int]] = {}  # by word with a blank before it

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank first: only for the few bytes of two neighbouring tokens."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 40), k) for k in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their joint bytes."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > 4 * CACHE:
                self.pairs.clear()
            x, y = self.bytes_of[a], self.bytes_of[b]
            got = self.pairs[a, b] = self.merged(x + y) == [x, y]
        return got

    def stream(self, chunks: Iterator[bytes]) -> Iterator[int]:
        """Ids of one piece, given in chunks of bytes, each as soon as no later byte can change it."""
        window = b""  # bytes of positions base+1 .. at
        base = at = 0
        last: dict[int, int] = {0: -1}  # position -> last token of the prefix that ends there
        done = 0  # position up to which tokens are emitted
        ranks, lookahead = self.ranks, self.lookahead

        def start(pos: int) -> int:
            return pos - len(self.bytes_of[last[pos]])

        def path(pos: int) -> list[int]:
            out = []
            while pos > done:
                out.append(last[pos])
                pos = start(pos)
            return out[::-1]

        for chunk in chunks:
            for k in range(len(chunk)):
                window += chunk[k : k + 1]
                at += 1
                tail = window[-2:]
                for n in (*self.lengths.get(tail, ()), *((1,) if len(tail) > 1 else ())):
                    if n > at - base or at - n not in last:
                        continue
                    t = ranks.get(window[-n:])
                    if t is not None and (at == n or self.fits(last[at - n], t)):
                        last[at] = t
                        break
                if at - done >= 4 * lookahead and at % lookahead == 0:
                    live = [p for p in range(at - lookahead + 1, at + 1) if p in last]
                    while len(set(live)) > 1:  # to the nearest common ancestor
                        far = max(live)
                        live = [start(p) if p == far else p for p in live]
                    if live[0] > done:
                        yield from path(live[0])
                        done = live[0]
                        floor = min(done, at - lookahead)
                        for p in [p for p in last if p < floor]:
                            del last[p]
                        window, base = window[-(at - floor) :] if at > floor else b"", floor
        yield from path(at)

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8", "surrogatepass")
        got = list(self.stream(data[k : k + 4096] for k in range(0, len(data), 4096)))
        if len(text) <= 64:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[text] = got
        return got

    @staticmethod
    def pieces(text: str) -> list[str]:
        if text.isascii() and not _ODD_BLANKS.search(text):
            return _PLAIN_PIECES.findall(text)
        import regex

        return regex.findall(PIECES, text)

    def word(self, text: str) -> list[int]:
        """Ids of a blank and the word after it. A worker remembers them by word."""
        out: list[int] = []
        for p in self.pieces(f" {text}"):
            out += self.known.get(p) or self.piece(p)
        if len(text) <= 64:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[text] = out
        return out

    def parts(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, part by part.

        No piece reaches over a blank into what stands before it, unless blanks follow each other: so but for such texts the parts
        are the words, each with the blank before it.
        """
        known, words = self.known, self.words
        if "  " in text:
            yield from (known.get(p) or self.piece(p) for p in self.pieces(text))
            return
        first, *rest = text.split(" ")
        yield from (known.get(p) or self.piece(p) for p in self.pieces(first))
        yield from (words.get(w) or self.word(w) for w in rest)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text or "")))

    def count(self, text: str | None) -> int:
        """How many ids `encode` gives, without making the list."""
        return sum(map(len, self.parts(text or "")))

    def decode(self, ids: Iterator[int]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if out := machine.decode(self.bytes_of[i]):
                yield out
        if out := machine.decode(b"", final=True):
            yield out


def read_ranks(path: str) -> bytes:
    return Path(path).read_bytes()


_MADE: dict[int, Transducer] = {}


def transducer(ranks_file: bytes) -> Transducer:
    """One for each vocabulary in a worker process."""
    key = hash(ranks_file)
    if key not in _MADE:
        _MADE[key] = Transducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a})
    return _MADE[key]


def encoder(spark, path: str = f"{TOKENIZERS}/{NAME}.tiktoken"):
    """A function Column -> Column of ids. The vocabulary file (under 1 MB) is read here and sent to each executor once."""
    held = spark.sparkContext.broadcast(read_ranks(path))

    def ids(text: pa.Array) -> pa.Array:
        t = transducer(held.value)
        return pa.array([t.encode(x) for x in text.to_pylist()], pa.list_(pa.int32()))

    ids.__annotations__ = {"text": pa.Array, "return": pa.Array}
    run = F.arrow_udf(ids, "array<int>")
    return lambda c: run(c)


def token_counter(spark, path: str = f"{TOKENIZERS}/{NAME}.tiktoken"):
    """A function Column -> Column of the number of ids."""
    held = spark.sparkContext.broadcast(read_ranks(path))

    def n_ids(text: pa.Array) -> pa.Array:
        t = transducer(held.value)
        return pa.array([t.count(x) for x in text.to_pylist()], pa.int32())

    n_ids.__annotations__ = {"text": pa.Array, "return": pa.Array}
    run = F.arrow_udf(n_ids, "int")
    return lambda c: run(c)


def decoder(spark, path: str = f"{TOKENIZERS}/{NAME}.tiktoken"):
    held = spark.sparkContext.broadcast(read_ranks(path))

    def text(ids: pa.Array) -> pa.Array:
        t = transducer(held.value)
        return pa.array([None if x is None else "".join(t.decode(x)) for x in ids.to_pylist()], pa.string())

    text.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    run = F.arrow_udf(text, "string")
    return lambda c: run(c)


def encoded(documents: DataFrame, *, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{NAME}.tiktoken") -> DataFrame:
    ids: Column = encoder(documents.sparkSession, path)(F.col(text))
    return spread(documents.select(F.col(key).alias(key), F.col(text).alias(text))).select(key, ids.alias("ids"))


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def p8_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Whether decoding gives each text back."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = decoder(spark)(encoder(spark)(F.col("text")))
    return docs.select("doc_id", (back == F.coalesce("text", F.lit(""))).alias("same"))

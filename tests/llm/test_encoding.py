import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkmill.llm import encoding as K

PATH = f"{K.TOKENIZERS}/{K.NAME}"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{PATH}.tiktoken"), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{PATH}.json")
    t.encode_special_tokens = True
    return K.transducer(K.read_ranks(f"{PATH}.tiktoken")), lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(both, text):
    mine, theirs = both
    assert mine.encode(text) == theirs(text)
    assert "".join(mine.decode(mine.encode(text))) == text


@settings(max_examples=600, deadline=None)
@given(text=st.text(alphabet=" \n\t\xa0\x1c\u3000ab'19s.é", max_size=24))
def test_blanks_of_every_sort(both, text):
    mine, theirs = both
    assert mine.encode(text) == theirs(text) and mine.count(text) == len(theirs(text))


def test_long_pieces_are_streamed(both):
    mine, theirs = both
    rnd = random.Random(1)
    for text in ["a" * 9000, "=-" * 3000, "ab" * 4000, " " * 2000 + "x", "é" * 3000, "".join(rnd.choice("tionsaer") for _ in range(12000)), "".join(rnd.choice("ab") for _ in range(8000)), "<|endoftext|>", "0" * 5000]:
        assert mine.encode(text) == theirs(text)
    held = mine.stream(iter([b"ab" * 40_000]))
    next(held)  # ids come before the piece has ended


def test_table(spark, both):
    df = spark.createDataFrame([(1, "hello world", 3), (2, None, 3), (3, "", 3), (3, "", 3), (None, " \n", 3), (4, "word " * 30_000, 3)], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id or 0), r.ids) for r in K.encoded(df).collect())
    assert got[0] == (0, both[1](" \n")) and got[1] == (1, both[1]("hello world")) and got[2:5] == [(2, []), (3, []), (3, [])] and len(got[5][1]) == len(both[1]("word " * 30_000))
    assert K.encoded(df.limit(0)).count() == 0
    assert [r[0] for r in spark.createDataFrame([([15496, 995],)], "x array<int>").select(K.decoder(spark)("x")).collect()] == ["Hello world"]

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glimmerframe.llm import encode as E
from glimmerframe.llm.queries import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
TRICKY = ["'s's don't ''ll we'll I've they're x's 'd", "  a  b \n\n c\t\td   ", "   ", " 's \n's", "漢字 <|endoftext|> x", "a" * 1000, "'S 'LL abc123 4.5", "🙂🙂 🙂", "x \xa0 z", "'", "a'", "a'l", "a'll", "a\x00b"]


@pytest.fixture(scope="module")
def known():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def ours(texts):
    flat, sizes, at = E.Encoder(E.read_ranks(VOCABULARY)).encode(texts)
    out, i = [], 0
    for n in sizes:
        out.append(flat[i : i + n].tolist())
        i += n
    return out


def test_equals_the_library(known):
    assert ours(TRICKY) == known(TRICKY)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 'slvterdm\n\t1?é漢 "), min_size=1, max_size=60), min_size=1, max_size=5))
def test_equals_the_library_on_random_texts(known, texts):
    assert ours(texts) == known(texts)


def test_round_trip_and_offsets():
    ranks = E.read_ranks(VOCABULARY)
    flat, sizes, at = E.Encoder(ranks).encode(["don't stop", "ünïcode 漢字"])
    assert E.decode(flat[: sizes[0]].tolist(), ranks) == "don't stop"
    assert E.decode(flat[sizes[0] :].tolist(), ranks) == "ünïcode 漢字"
    assert at[: sizes[0]].tolist() == [0, 3, 5]


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hi there", "x"), (2, "", "y"), (3, None, "z"), (1, "Hi there", "x"), (None, "a", "w"), (5, "word " * 300_000, "v")], "doc_id long, text string, ids string")
    rows = sorted(E.encode(df, VOCABULARY).collect(), key=lambda r: (r.doc_id or 0, len(r.ids)))
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 5]
    assert rows[1].ids == rows[2].ids == [17250, 612] and rows[3].ids == rows[4].ids == []
    assert len(rows[5].ids) == 300_001 and E.encode(df, VOCABULARY, with_offsets=True).columns == ["doc_id", "ids", "offsets"]
    assert E.encode(df.limit(0), VOCABULARY).collect() == []

import os

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from loglattice.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def whole():
    return tokens.Encoder(tokens.vocabulary()).encoding


@pytest.fixture(scope="module")
def cutter():
    return tokens.Encoder(tokens.vocabulary())


def listed(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<i4").tolist()


HARD = ["a\n\nb", "a  b\t c", "it's 'll'x 'sz", "à b é c  d", "<|endoftext|> x", "0x7f zqjx QZ", "​ ﻿ x", "日本 語 text", "emoji 🎉 🎉!", "!!' 's", " ", "\r\n x\r\n\r\ny", "a　b", "\x00\x01 x", "x" * 5000, "qzxj" * 3000, " " * 3000, "*" * 3000 + " x"]


@pytest.mark.parametrize("text", HARD)
def test_fragments_give_the_whole_texts_ids(whole, cutter, text):
    assert listed(cutter.encode(text)) == whole.encode_ordinary(text)
    assert "".join(cutter.fragments(text)) == text


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'sltmdvreqzxj09.,!?-_  éàß語🎉"), st.characters(exclude_categories=["Cs"])), max_size=200))
def test_any_text(whole, cutter, text):
    assert listed(cutter.encode(text)) == whole.encode_ordinary(text)


def test_round_trip(cutter):
    for text in HARD:
        assert cutter.encoding.decode(listed(cutter.encode(text))) == text


def test_pairs_are_never_inside_a_token():
    ranks = tokens.parse_ranks(tokens.vocabulary())
    pairs = tokens.inner_pairs(ranks)
    certain, (apart, letters) = tokens.before_space(pairs), tokens.between_letters(pairs)
    for token in ranks:
        try:
            text = token.decode("ascii")
        except UnicodeDecodeError:
            continue
        assert letters.search(text) is None and apart.search(text) is None, token
        assert not any(a in certain and b in tokens.SPACES for a, b in zip(text, text[1:])), token


def test_every_certain_cut_is_made(cutter):
    text = "the cat sat on the mat qzxj\nthe end"
    assert list(cutter.fragments(text)) == ["the", " cat", " sat", " on", " the", " mat", *[f" {x}" if i == 0 else x for i, x in enumerate(cutter.letters.split("qzxj"))], "\nthe", " end"]
    assert len(cutter.letters.split("qzxj")) > 1
    assert list(cutter.fragments("à b c")) == ["à b", " c"]  # not certain after other scripts


def test_each_distinct_fragment_is_encoded_once(monkeypatch):
    own = tokens.Encoder(tokens.vocabulary())
    asked = []
    real = own.encoding

    class Counted:
        def encode_ordinary(self, text):
            asked.append(text)
            return real.encode_ordinary(text)

    monkeypatch.setattr(own, "encoding", Counted())
    text = "one two two two one " * 50
    assert listed(own.encode(text)) == real.encode_ordinary(text)
    assert len(asked) == len(set(asked)) < 6
    small = tokens.Encoder(tokens.vocabulary(), held=3)
    for t in ("a b c d e f g", text, "x" * 1000 + " y", text):
        assert listed(small.encode(t)) == real.encode_ordinary(t)
    assert len(small) <= 3


def test_table(spark, whole):
    rows = [(1, None, "clash"), (2, "", "x"), (3, "again", "x"), (3, "again", "x"), (None, "long " * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in tokens.encode(df, "text", ["doc_id"]).collect()]
    want = [(i, whole.encode_ordinary(t) if t else []) for i, t, _ in rows]
    order = lambda x: (x[0] is None, x[0] or 0, len(x[1]))
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sorted(r["n_tokens"] for r in tokens.sizes(df, "text", ["doc_id"]).collect()) == sorted(len(w[1]) for w in want)
    assert tokens.encode(df.limit(0), "text", ["doc_id"]).count() == 0

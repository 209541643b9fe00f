"""Encoding and decoding against the library, over all documents and made-up strings."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shelftally.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(library, texts):
    model = pieces.load(PATH)
    ids, offsets = pieces.encode(model, texts)
    decoded = pieces.decode(model, ids, offsets)
    for i, text in enumerate(texts):
        want = library.encode(text)
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want, text
        assert decoded[i].decode() == library.decode(want), text


def test_odd_texts(library):
    check(
        library,
        ["", " ", "  ", "   a", "a\n\n b", "▁", "▁▁ x", "</s><s><unk>", "<0x0A>", "\x00\x01", "é", "é", "\U0001f600\U0001f600",
         "aaaaaaaaaaaaaaaaa", " " * 40, " " * 17 + "the", "\t\ttabs\tand  spaces ", "日本語テキスト", "the" * 50, "�", "a b", "ﷺ"],
    )


def test_random_strings(library):
    rng = random.Random(3)
    alphabet = "aaabcdeeehinorstt   the \n▁éß世界.,0123456789ABC_-"
    check(library, ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)])
    model = pieces.load(PATH)
    shown = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    check(library, ["".join(rng.choice(shown) for _ in range(rng.randrange(12))) for _ in range(3000)])
    assert model.hurried.any()


def test_whole_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    found = {r["doc_id"]: r for r in pieces.token_digests(docs, PATH).collect()}
    assert len(found) == len(rows)
    for r in rows:
        ids = library.encode(r["text"])
        got = found[r["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_defined_cases(spark):
    rows = [(1, None, 1), (1, None, 2), (None, "", 3), (2, "x" * 400_000, 4), (3, "the " * 100_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = sorted(((r["doc_id"] or 0, len(r["ids"]), r["decoded"]) for r in pieces.tokens(docs, PATH).collect()))
    assert got[:3] == [(0, 0, ""), (1, 0, ""), (1, 0, "")]
    assert got[3][2] == "x" * 400_000 and got[4][2] == "the " * 100_000
    empty = hashlib.sha256(b"").hexdigest()
    assert pieces.token_digests(docs.limit(1), PATH).first()[1:] == (0, empty, empty)
    assert pieces.tokens(docs.limit(0), PATH).count() == 0


def test_decode_of_any_ids(library):
    rng = np.random.default_rng(1)
    model = pieces.load(PATH)
    for _ in range(300):
        ids = rng.integers(3, 600, rng.integers(1, 12))
        got = pieces.decode(model, ids, np.array([0, len(ids)]))[0].decode()
        assert got == library.decode(ids.tolist()), ids


@pytest.mark.parametrize("size", [65, 20_001, 200_000])
def test_long_words_take_no_square_of_their_length(library, size):
    """Runs of one character and words without white space, alone and beside short words."""
    rng = random.Random(size)
    joined = "".join(rng.choice(["the", "ing", "tion", "Hello", "sch", "über", "123", "----", "ooo", "=", "_"]) for _ in range(size // 4))
    start = time.perf_counter()
    for text in (" " * size, "-" * size, " -" * (size // 2), joined, f"a b{' ' * size}c {joined} d"):
        model = pieces.load(PATH)
        ids, _ = pieces.encode(model, [text])
        assert ids.tolist() == library.encode(text)
    assert time.perf_counter() - start < 60


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from(" -=_aeth.▁0é"), max_size=300))
def test_queue_and_rounds_agree(text):
    """The queue alone gives what the rounds give."""
    model = pieces.load(PATH)
    points = model.by_char[[ord(c) for c in text]] if text else np.zeros(0, np.int64)
    rounds, _ = pieces.merge_words(model, points.copy(), np.zeros(len(points), np.int64))
    if len(points):
        assert pieces.merge_in_order(model, points.copy()).tolist() == rounds.tolist()

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioflow.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.Bpe(open(PATH, "rb").read())


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = OWN.encode(text).tolist()
    assert got == want, repr(text[:200])
    assert OWN.decode(OWN.encode(text)) == LIBRARY.decode(want, skip_special_tokens=False)
    n, ids, dec = OWN.digests([text])[0]
    assert n == len(want)
    assert ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert dec == hashlib.sha256(text.encode()).hexdigest()


def test_every_code_point():
    for at in range(0, 0x110000, 512):
        chars = [chr(c) for c in range(at, at + 512) if not 0xD800 <= c < 0xE000]
        same("".join(f"a{c}1{c} {c}{c}'s\n" for c in chars))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="abcdethinor <|>\n'st ", max_size=80))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ainterogs", min_size=1, max_size=200))
def test_long_pieces(text):
    same(text)
    same(text * 9)


def test_special_strings_and_long_texts():
    for t in ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "x" * 100_000, "ab" * 30_000, " " * 5000 + "x", "\n" * 999, "é🙂" * 5000]:
        same(t)


@pytest.fixture
def docs(spark):
    rows = [(1, "The the. Ñandú", 5), (2, None, 5), (3, "", 5), (None, "x y", 5), (1, "The the. Ñandú", 5), (4, "w " * 50_000, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int"), rows


def test_tables_and_round_trip(spark, docs):
    df, rows = docs
    back = bpe.decode(bpe.encode(df)).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back) == sorted((i or -1, t or "") for i, t, _ in rows)
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["decoded_sha256"]) for r in bpe.round_trip(df).collect())
    want = sorted((i or -1, len(LIBRARY.encode(t or "").ids), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert got == want
    assert bpe.round_trip(df.limit(0)).count() == 0

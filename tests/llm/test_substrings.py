import hashlib
import random
from collections import Counter

import pytest

from folioflow.llm import substrings

SCHEMA = "doc_id long, text string, anchor int, spans string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    hot = text(90)
    out = [None, "", "short", "a" * 300, "ab" * 200, text(3000)]
    for _ in range(80):
        t = text(rng.choice([10, 39, 40, 200, 900]))
        out.append(t)
        for _ in range(rng.choice([0, 0, 1, 3])):
            at = rng.randrange(len(t))
            out.append(t[:at] + text(rng.choice([0, 1, 30])) + t[at + rng.choice([0, 1, 5]) :])
    out += [text(rng.randrange(60)) + hot + text(rng.randrange(60)) for _ in range(60)]
    out += [out[-1], hot + hot, text(50) + hot[:45], hot[44:] + text(70)]
    return out


@pytest.mark.parametrize(("chunk", "cell"), [(800, 16), (7, 16), (7, 5), (3, 1)])
def test_against_counting(spark, monkeypatch, chunk, cell):
    # Workers load the module anew, so the smaller constants go along inside the functions' module copy.
    for k, v in {"LENGTH": 40, "GRAM": 8, "CHUNK": chunk, "CELL": cell, "SHARD_BYTES": 5000, "BLOCK": 256}.items():
        monkeypatch.setattr(substrings, k, v)
    from tests.llm import cloudpickle_here

    with cloudpickle_here.by_value(substrings):
        texts = corpus(chunk + cell)
        df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], SCHEMA)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(df).collect()}
    want = brute(texts, 40)
    assert [got[i] for i in range(len(texts))] == want


def test_full_length_repeated_rows_and_empty_table(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(70))
    other = [" ".join(word() for _ in range(n)) for n in (100, 300, 10)]
    texts = [other[0] + passage + other[1], passage, other[1], other[2], "x" * 2000, None, other[0] + passage[:399]]
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)] + [(3, texts[3], 0, "x"), (2, texts[2], 0, "x"), (None, passage, 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(df).collect())
    want = sorted((r[0] is None, r[0] or 0, *x) for r, x in zip(rows, brute([r[1] for r in rows], 400), strict=True))
    assert got == want
    assert substrings.remove_repeats(df.limit(0)).count() == 0

import numpy as np
import pytest

from folioflow.llm import mixing

SCHEMA = "doc_id long, source string, text string, copies int, size string"


def level_targets(sizes):
    """Share by weight, cap, and share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    t, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return t | share
        for s in over:
            t[s] = 3.0 * sizes[s]
            left -= t[s]
        open_ -= over
    return t


def docs(spark, seed, n, skew=0.4):
    rng = np.random.default_rng(seed)
    data = []
    for i in range(n):
        s = "hot" if rng.random() < skew else [None, "a", "é", "b", "tiny"][rng.integers(5)]
        data.append((i, s, "w " * int(rng.integers(0, 3 if s == "tiny" else 60)), 1, "x"))
    data += [(7, "a", "same text here", 1, "x")] * 3 + [(None, "a", None, 1, "x"), (8, "zero", "", 1, "x")]
    return spark.createDataFrame(data, SCHEMA), data


@pytest.mark.parametrize("group", [4096, 8])
def test_sources_meet_their_targets(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    monkeypatch.setattr(mixing, "FAN", 4)
    df, data = docs(spark, 1, 1500)
    m = mixing.mix(df).collect()
    assert sum(r["rows"] for r in m) == len(data)
    sizes, taken = {}, {}
    for r in m:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"] * r["rows"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["rows"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    want = level_targets(sizes)
    for r in m:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60, s
    again = {(r["doc_id"], r["text_key"]): r["copies"] for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["text_key"]): r["copies"] for r in m}


def test_expected_copies_are_kept(spark):
    df = spark.createDataFrame([(i, s, "w " * (1 + i % 7), 1, "") for i in range(40) for s in ("a", "b", "c")], SCHEMA)
    total = np.zeros(3)
    for seed in range(6):
        for r in mixing.mix(df, seed=seed).where("doc_id < 20").collect():
            total["abc".index(r["source"])] += r["copies"]
    assert np.allclose(total / 120, [15 / 8, 6 / 8, 3 / 8], atol=0.2)


def test_stage_repeats_documents_and_empty_table(spark):
    df, data = docs(spark, 2, 300)
    out = mixing.keep_mix(spark, df, "")
    assert out.columns == df.columns
    n = {}
    for r in out.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    m = {}
    for r in mixing.mix(df).collect():
        m[r["doc_id"]] = m.get(r["doc_id"], 0) + r["copies"] * r["rows"]
    assert n == {k: v for k, v in m.items() if v}
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0

import random
from collections import Counter

import numpy as np

from folioflow.llm import bagminhash as bag
from folioflow.llm import near

SCHEMA = "doc_id long, text string, group_id int, keys string"


def multiset(text):
    w = (text or "").split(" ")
    w = [x for x in w if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    bags = [multiset(r[1]) for r in rows]
    root = list(range(len(rows)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if bags[a] and bags[b]:
                both = sum((bags[a] & bags[b]).values())
                if both / sum((bags[a] | bags[b]).values()) >= 0.8:
                    root[up(a)] = up(b)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(up(i), []).append(r[0])
    return sorted((rows[i][0], min(least[up(i)])) for i in range(len(rows)))


def corpus(seed, n, group):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    base = [[word() for _ in range(rng.choice([3, 8, 60, 200]))] for _ in range(n)]
    base += [["x"] * 90 + [word() for _ in range(30)]]
    rows = []
    for b in base:
        for _ in range(rng.choice([1, 1, 2, 5])):
            t = list(b)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t))
    hot = [word() for _ in range(150)]
    for _ in range(group):
        t = list(hot)
        for _ in range(rng.choice([1, 2, 3, 4])):
            t[rng.randrange(len(t))] = word()
        rows.append(" ".join(t))
    rows += ["", " ", "one", "one", "a b", "x " * 50_000]
    return [(i + 1, t, 0, "k") for i, t in enumerate(rows)]


def test_against_all_pairs(spark, monkeypatch):
    for block, bound, seed in ((400, 50_000, 1), (7, 0, 2)):
        monkeypatch.setattr(near, "BLOCK", block)
        monkeypatch.setattr(near, "BROADCAST_BUCKETS", bound)
        rows = corpus(seed, 60, 90)
        got = near.near_documents(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted((r["doc_id"], r["group_id"]) for r in got) == brute(rows)
        assert all(r["kept"] == (r["doc_id"] == r["group_id"]) for r in got)


def test_registers_agree_by_weighted_jaccard():
    rng = np.random.default_rng(1)
    for wide in (1, 5, 60):
        x = {int(k): int(rng.integers(1, wide + 1)) for k in rng.integers(0, 2**62, 80)}
        y = {k: int(rng.integers(1, wide + 1)) for k in list(x)[:60]} | {int(k): 1 for k in rng.integers(0, 2**62, 10)}
        parts = [np.sort(np.repeat(np.array(list(d), np.uint64), list(d.values()))) for d in (x, y)]
        want = bag.overlap(*parts)
        m = 8192
        s = bag.signatures(parts, m)
        assert abs((s[0] == s[1]).mean() - want) < 5 * np.sqrt(want * (1 - want) / m) + 1e-9
        # A signature doesn't depend on what it is computed with.
        assert (bag.signatures([parts[1]], m)[0] == s[1]).all()


def test_stage_and_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, 1, "k"), (3, text, 1, "k"), (3, text, 1, "k"), (None, "other words here", 1, "k"), (7, None, 1, "k"), (8, "", 1, "k"), (9, text + " more", 1, "k")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = near.keep_one(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == sorted([(3, text), (0, "other words here"), (7, None), (8, "")], key=lambda x: x[0])
    assert near.keep_one(spark, df.limit(0), "").count() == 0

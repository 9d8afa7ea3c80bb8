import numpy as np
import pytest

from folioflow.llm import toxicity

SCHEMA = "doc_id long, text string, toxic int, p_toxic string"


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'abcdefghijklmnopqrstuvwxyz'[k // 26]}" for k in rng.integers(0, 400, rng.integers(5, 80))]
        insult, threat = rng.random() < 0.15, rng.random() < 0.1
        if insult:
            words.insert(0, "nasty" + "abcdefgh"[rng.integers(8)] * 2 + ".")
        if threat or (insult and rng.random() < 0.5):
            threat = True
            words.append("HURTING")
        rows.append((i, " ".join(words), 1, "x"))
        labels.append((i, int(insult), int(threat)))
    return rows, labels


def test_held_out_accuracy_and_chain(spark):
    rows, labels = corpus(1500, 1)
    docs = spark.createDataFrame(rows + [(None, None, 1, "x"), (5000, None, 1, "x"), (5001, "", 1, "x"), (5002, "nastyxy " + "wab " * 100_000, 1, "x"), (3, rows[3][1], 1, "x")], SCHEMA)
    known = spark.createDataFrame([r for r in labels if r[0] < 1000] + [(1, None, 0), (2, 0, 0), (None, 1, 1)], "doc_id long, insult int, threat int")
    chain = toxicity.train_chain(docs, known, ["insult", "threat"])
    # Each category comes first in one chain, and in the other its model has the first one's as input.
    assert chain.orders == [[0, 1], [1, 0]] and all(len(later) == len(first) + 1 for first, later in chain.models)
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    assert len(got) == 1504 - 0 and got[5000]["p_insult"] == got[5001]["p_insult"]
    held = [r for r in labels if r[0] >= 1000]
    for c, k in (("insult", 1), ("threat", 2)):
        right = np.mean([(got[r[0]][f"p_{c}"] > chain.thresholds[k - 1]) == bool(r[k]) for r in held])
        assert right > 0.98, (c, right)
    assert got[5002]["p_insult"] > chain.thresholds[0]


def test_no_labels_one_value_and_empty_table(spark):
    rows, labels = corpus(50, 2)
    docs = spark.createDataFrame(rows, SCHEMA)
    none = toxicity.train_chain(docs, spark.createDataFrame([], "doc_id long, a int"), ["a"])
    assert {r["p_a"] for r in toxicity.score(docs, none).collect()} == {0.5}
    one = toxicity.train_chain(docs, spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, a int"), ["a"])
    assert max(r["p_a"] for r in toxicity.score(docs, one).collect()) < 0.01
    assert toxicity.score(docs.limit(0), one).count() == 0
    # Labels of documents that aren't there count for nothing.
    away = toxicity.train_chain(docs, spark.createDataFrame([(1000 + i, i % 2) for i in range(50)], "doc_id long, a int"), ["a"])
    assert {r["p_a"] for r in toxicity.score(docs, away).collect()} == {0.5}


def test_solver_against_gradient():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(12) < 0.3) for _ in range(300)]
    y = (rng.random(300) < 0.4).astype(float)
    x = toxicity.Sparse(rows, 12, np.ones((300, 1)))
    w = toxicity.fit(x, y, steps=200)
    p = 1 / (1 + np.exp(-x.times(w)))
    assert np.abs(x.back(p - y) + 0.3 * np.append(w[:-1], 0)).max() < 0.05
    assert toxicity.best_cut(np.array([3.0, 2.0, -1.0]), np.array([1, 1, 0]))[1] == pytest.approx(1.0)


def dense_fit(x, y):
    """Ridge logistic regression by Newton steps over a matrix whose last column is the intercept."""
    w = np.zeros(x.shape[1])
    pen = np.full(len(w), toxicity.RIDGE)
    pen[-1] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + pen * w)
    return w


def test_chains_against_a_plain_version():
    rng = np.random.default_rng(4)
    vocabulary, n = [f"w{c}" for c in "abcdefghij"], 240
    texts = [" ".join(w for w in vocabulary if rng.random() < 0.3) for _ in range(n)]
    x = np.array([[w in t.split() for w in vocabulary] for t in texts], float)
    first = (x @ rng.normal(0, 1.5, 10) + rng.normal(0, 1, n) > 0.5).astype(int)
    second = (x @ rng.normal(0, 1, 10) + 2 * first + rng.normal(0, 1, n) > 1).astype(int)
    labels, folds = np.column_stack([first, second]), np.arange(n) % toxicity.FOLDS
    chains = toxicity.Chains(vocabulary, ["a", "b"])
    chains.train([np.array(sorted(chains.numbers(t))) for t in texts], labels, folds)
    want = np.zeros((n, 2))
    for a, b in ((0, 1), (1, 0)):
        one = np.column_stack([x, np.ones(n)])
        out = np.zeros(n)
        for k in range(toxicity.FOLDS):
            out[folds == k] = one[folds == k] @ dense_fit(one[folds != k], labels[folds != k, a])
        two = np.column_stack([x, np.clip(out, -12, 12), np.ones(n)])
        za = one @ dense_fit(one, labels[:, a])
        zb = np.column_stack([x, np.clip(za, -12, 12), np.ones(n)]) @ dense_fit(two, labels[:, b])
        want[:, a] += za / 2
        want[:, b] += zb / 2
    assert np.abs(chains.scores(texts) - 1 / (1 + np.exp(-want))).max() < 0.02

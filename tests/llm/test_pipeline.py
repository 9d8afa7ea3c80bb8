import hashlib
import random
from collections import Counter

import corpus_pipeline
import pytest
from folioflow.llm import mixing
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_mixing import level_targets
from tests.llm.test_near import brute as brute_near
from tests.llm.test_quality import brute as brute_rules


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "w" + "".join(rng.choice("abcdefg") for _ in range(4))
    line = lambda n: " ".join(word() for _ in range(n))
    boiler = [line(6) for _ in range(4)]
    rows = []
    for i in range(260):
        t = [line(rng.randrange(5, 30)) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.4:
            t.insert(rng.randrange(len(t) + 1), rng.choice(boiler))
        if rng.random() < 0.1:
            t = ["spam eggs ham and some more of it " * 20]
        rows.append((i, "\n".join(t), "en", rng.choice(["a", "b", "c", "d", "e", "f", None]), 0))
    for i in range(60):
        _, t, *rest = rng.choice(rows)
        w = t.split(" ")
        w[rng.randrange(len(w))] = word()
        rows.append((300 + i, rng.choice([t, " ".join(w)]), *rest))
    return rows + [(400, None, "en", "a", 0), (401, "", None, "a", 0)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = corpus(6)
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return rows, path


def test_against_plain_stages(spark, table):
    rows, path = table
    docs, stages = spark.read.parquet(f"{path}/documents.parquet"), dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = stages[name](spark, docs, path)
        assert out.columns == docs.columns
        return spark.createDataFrame(out.collect(), docs.schema)

    good = step("quality rules", docs)
    want = []
    for r in rows:
        n, _, _, _, rep = brute_rules(r[1])
        if not (n < 20 or 100 * rep > 30 * n):
            want.append(r)
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(r[0] for r in want)  # no host is over the limit here

    lined = step("line dedup", good)
    clean = brute_lines([(r[0], r[3], r[1]) for r in want], 5)
    assert sorted((r["doc_id"], r["text"]) for r in lined.collect()) == sorted(clean)

    single = step("near duplicates", lined)
    groups = brute_near([(d, t.replace("\n", " ")) for d, t in clean])
    empty = {d for d, t in clean if not t.split()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(d for d, g in groups if d == g or d in empty)

    mixed = step("source mix", single)
    sizes, most = Counter(), 0
    for r in single.collect():
        sizes[r["source"]] += len(r["text"].split())
        most = max(most, len(r["text"].split()))
    taken = Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
    for s, t in level_targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= most
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= mixing.MOST_COPIES

    last = stages["encoding"](spark, mixed, path).collect()
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert len(last) == mixed.count()
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in last)
    whole = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, path).collect())
    assert whole == sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in last)


def test_empty_table(spark, table, tmp_path):
    _, path = table
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

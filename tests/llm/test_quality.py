import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import quality

SCHEMA = "doc_id long, source string, text string, rules double, host_rejected int"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(wins)
    cov = {j for i, x in enumerate(wins) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cov))


def check(spark, texts):
    df = spark.createDataFrame([(i, "h", t, 0.5, 3) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["rules"] for r in quality.with_rules(df).collect()}
    for i, t in enumerate(texts):
        r, b = got[i], brute(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b, repr(t)
        assert r["base_failed"] == (b[0] < 20 or 100 * b[4] > 30 * b[0])


def test_fixed_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    check(spark, [None, "", " \n\t", "a", "a b c d e f g h", "a " * 40, "x\nx\n \n \nx y\nx y", "é ñ 🙂 #$%", long, "1 2 3 4 5 6 7 8 " * 2 + "9 " * 3])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n|é", max_size=120), min_size=1, max_size=30))
def test_any_text(spark, texts):
    check(spark, texts)


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(30))
    data = [(i, "bad", "x" if i % 10 else good, 0.0, 0) for i in range(100)] + [(100 + i, "good", good if i % 10 else "x", 0.0, 0) for i in range(100)]
    data += [(300, None, good, 0.0, 0), (301, None, "x", 0.0, 0), (100, "good", good, 0.0, 0)]
    docs = spark.createDataFrame(data, SCHEMA)
    kept = quality.keep_quality(spark, docs, "")
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert kept.columns == docs.columns
    assert ids == sorted([100] + [100 + i for i in range(100) if i % 10] + [300])


def test_empty_table_and_salted_join(spark, monkeypatch):
    assert quality.keep_quality(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 0)
    test_bad_hosts_take_their_documents_along(spark)

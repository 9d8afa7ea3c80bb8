import random

from folioflow.llm import lines

SCHEMA = "doc_id long, source string, text string, line int, first string"
SPACE = " \t\n\x0b\x0c\r"


def brute(rows, min_sites):
    sites, first = {}, {}
    for d, s, t, *_ in rows:
        for p, raw in enumerate((t or "").split("\n")):
            k = raw.strip(SPACE)
            if k:
                sites.setdefault(k, set()).update([s] if s is not None else [])
                first.setdefault(k, []).append((d, t or "", p))
    out = []
    for d, s, t, *_ in rows:
        if t is None:
            out.append((d, None))
            continue
        left = []
        for p, raw in enumerate(t.split("\n")):
            k = raw.strip(SPACE)
            lead = min(first[k], key=lambda x: (x[0] is not None, x[0] or 0, x[2])) if k else None
            if not k or len(sites[k]) < min_sites or (lead[0], lead[2]) == (d, p):
                left.append(raw)
        out.append((d, "\n".join(left)))
    return out


def test_against_counting(spark, monkeypatch):
    rng = random.Random(3)
    pool = [f"line {i} é" for i in range(40)] + ["", "  ", "line 1 é "]
    rows = [(i, rng.choice([None, *"abcdefghij"]), "\n".join(rng.choice(pool) for _ in range(rng.randrange(12))), 1, "x") for i in range(150)]
    rows += [(1000, "a", None, 1, "x"), (1001, "b", "", 1, "x"), (1002, "c", "hot\n" * 3000, 1, "x")]
    rows += [(2000 + i, "abcdefghij"[i % 10], "hot\nonly %d" % i, 1, "x") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    for bound in (10**6, 0):
        monkeypatch.setattr(lines, "BROADCAST_LINES", bound)
        for band in (0.2, 2.0):
            for k in (3, 7):
                got = lines.drop_lines(df, k, band).select("doc_id", "text").collect()
                assert sorted((r[0], r[1] or "", r[1] is None) for r in got) == sorted((d, t or "", t is None) for d, t in brute(rows, k))


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, s, "same\nown", 1, "x") for s in "aaabcdef"] + [(1, "a", "same\nown", 1, "x"), (None, "g", "same", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lines.drop_boilerplate(spark, df, "")
    assert got.columns == df.columns
    texts = sorted((r["doc_id"] or 0, r["text"]) for r in got.collect())
    assert texts == [(0, "same")] + [(1, "own")] * 9 or texts == [(0, "same")] + [(1, "own")] * 9
    assert lines.drop_boilerplate(spark, df.limit(0), "").count() == 0

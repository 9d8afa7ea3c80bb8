import numpy as np
import pandas as pd

from folioflow.llm import components, embedding

SCHEMA = "vec_id long, embedding array<double>, label int, n int, rep string"


def brute(rows, cosine):
    ok = [i for i, r in enumerate(rows) if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    root, links = {i: i for i in range(len(rows))}, dict.fromkeys(range(len(rows)), 0)

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ok:
        for b in ok:
            x, y = (np.float64(rows[k][1]) / np.abs(rows[k][1]).max() for k in (a, b))
            if a < b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a] += 1
                links[b] += 1
                root[up(b)] = up(a)
    least = {}
    for i in range(len(rows)):
        least.setdefault(up(i), []).append(rows[i][0])
    return sorted((rows[i][0] or -1, links[i], least[up(i)][0] is not None and min(least[up(i)]) or least[up(i)][0] or -1) for i in range(len(rows)))


def vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    rows = []
    for i in range(400):
        v = base[min(59, int(rng.exponential(6)))] + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.3, 2.0])
        rows.append((i + 1, [float(x) for x in np.float32(v)], 1, 1, "x"))
    hot = [float(x) for x in np.float32(base[0])]
    rows += [(1000 + i, hot, 2, 1, "x") for i in range(150)]
    rows += [(2000, None, 1, 1, "x"), (2001, [0.0] * 16, 1, 1, "x"), (2002, [], 1, 1, "x"), (2003, [1.0, None] * 8, 1, 1, "x")]
    # Doubles that single precision doesn't hold, parallel or just beside the threshold.
    near = 0.95 + 1e-9
    rows += [(2100, [1e200, 1e200], 1, 1, "x"), (2101, [2.0, 2.0], 1, 1, "x"), (2102, [1e39, 0.0], 1, 1, "x"), (2103, [1.0, 0.0], 1, 1, "x")]
    rows += [(2104, [near, (1 - near**2) ** 0.5], 1, 1, "x"), (2105, [1e-320, 0.0, 0.0, 0.0], 1, 1, "x"), (2106, [5.0, 1.0, 0.0, 0.0], 1, 1, "x")]
    far = 0.95 - 1e-9
    rows += [(2107, [0.0, 1.0, 0.0, 0.0, 0.0], 1, 1, "x"), (2108, [(1 - far**2) ** 0.5, far, 0.0, 0.0, 0.0], 1, 1, "x")]
    rows += [(2004, [float("nan")] * 16, 1, 1, "x"), (2005, [1.0] * 3, 1, 1, "x"), (2006, [2.0] * 3, 1, 1, "x"), (2007, [float("inf")] * 16, 1, 1, "x")]
    return rows


def test_against_all_pairs(spark, monkeypatch):
    rows = vectors()
    want = brute(rows, 0.95)
    df = spark.createDataFrame(rows, SCHEMA)
    for block, bound in ((1000, 20_000), (20, 20_000), (20, 0)):
        monkeypatch.setattr(embedding, "BLOCK", block)
        monkeypatch.setattr(embedding, "BROADCAST_BUCKETS", bound)
        got = embedding.near_vectors(df).collect()
        assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1) for r in got) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_doubles_link(spark):
    near = 0.95 + 1e-9
    rows = [[1e200, 1e200], [2.0, 2.0], [1e39, 0.0], [1.0, 0.0], [near, (1 - near**2) ** 0.5], [0.95 - 1e-9, -((1 - (0.95 - 1e-9) ** 2) ** 0.5)]]
    got = embedding.near_vectors(spark.createDataFrame([(i, r, 0, 0, "") for i, r in enumerate(rows)], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(0, 1, 0), (1, 1, 0), (2, 2, 2), (3, 2, 2), (4, 2, 2), (5, 0, 5)]


def test_vectors_are_asked_for_by_their_neighbours_alone(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 32))
    v[1::100] = v[::100] + 0.05 * rng.standard_normal((30, 32))
    bits, tables = embedding.plan(3000, 0.95)
    hashed = pd.concat(embedding._hashed(bits, tables)([pd.DataFrame({"rep": np.arange(3000), "v": list(v)})])).sort_values(["t", "code", "rep"])
    most = embedding.most_different(max(embedding.SIGNS, bits * tables), 0.95)
    asked = pd.concat(embedding._asked(bits, tables, most)([hashed.assign(i=0, j=0, c=0)]))
    assert {i + k for i in range(0, 3000, 100) for k in (0, 1)} <= set(asked["rep"]) and len(asked) < 0.02 * len(hashed)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0, 0, "")] * 3 + [(None, [1.0, 2.0], 0, 0, "")], SCHEMA)
    got = sorted((r["vec_id"] or -1, r["n_links"], r["kept"]) for r in embedding.near_vectors(df).collect())
    assert got == [(-1, 0, True)] + [(1, 2, True)] * 3
    assert embedding.near_vectors(df.limit(0)).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(1, 60)] + [(500, 500 + i) for i in range(1, 200)] + [(900, 901), (901, 902), (902, 900), (950, 950)]
    edges += [(int(a), int(b)) for a, b in rng.integers(2000, 2100, (60, 2))]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    a, b = np.array(edges).T
    want = components.local_roots(2200, a, b)
    assert got == {i: int(want[i]) for i in range(2200) if want[i] != i}

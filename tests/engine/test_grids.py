import pytest

from folioflow.operators import grids

FRAGMENTS = "doc_id long, page int, seq long, text string, x double, y double, width double, height double"
RULES = "doc_id long, page int, x1 double, y1 double, x2 double, y2 double"


def test_tables_are_detected(spark):
    cell = lambda page, r, c, width=100.0: (1, page, r * 3 + c, f"{r}{c}", 100.0 * c, 700.0 - 20 * r, width, 20.0)
    rows = [cell(1, r, c) for r in range(3) for c in range(3)]
    # Page 2: the first cell goes over two columns. Page 3: ragged text is no table. Page 4: far below, one line more.
    rows += [cell(2, 0, 0, 199.0), cell(2, 0, 2)] + [cell(2, r, c) for r in (1, 2) for c in range(3)]
    rows += [(1, 3, i, "w", 37.0 * i * i % 400, 700.0 - 17 * i - i % 3 * 5, 11.0 + 13 * i, 9.0) for i in range(8)]
    rows += [cell(4, r, c) for r in range(3) for c in range(3)] + [(1, 4, 99, "x", 0.0, 100.0, 10.0, 10.0)]
    lines = [(1, 1, 0.0, 720.0 - 20 * i, 300.0, 720.0 - 20 * i) for i in range(4)] + [(1, 1, 100.0 * i, 660.0, 100.0 * i, 720.0) for i in range(4)]
    got = {r["page"]: r for r in grids.detect_tables(spark.createDataFrame(rows, FRAGMENTS), spark.createDataFrame(lines, RULES)).collect()}
    assert sorted(got) == [1, 2, 4]
    assert got[1]["confidence"] == pytest.approx(1.0) and got[1]["has_grid"] and not got[4]["has_grid"]
    assert got[4]["confidence"] == pytest.approx(0.8)
    assert [(c["row"], c["col"], c["text"]) for c in got[1]["cells"]] == [(r, c, f"{r}{c}") for r in range(3) for c in range(3)]
    assert (got[1]["x"], got[1]["y"], got[1]["width"], got[1]["height"]) == (0, 660, 300, 60)
    spans = {(c["row"], c["col"]): (c["row_span"], c["col_span"]) for c in got[2]["cells"]}
    assert spans.pop((0, 0)) == (1, 2) and set(spans.values()) == {(1, 1)}

"""Steps whose cost has to go by their input, on inputs where it would show, and results where ends meet."""

import gc
import time
import weakref

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioflow import shared
from folioflow.functions import sentences, tables
from folioflow.operators import grids, layout
from folioflow.plans import catalog, documents
from folioflow.sources import html

SF = "/root/testdata/sf0.001"


def fragments(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, page long, seq long, text string, x double, y double, width double, height double, font_size double")


def large_page(spark, n):
    i = F.col("id")
    return spark.range(n).select(
        F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("page"), i.alias("seq"), F.concat(F.lit("w"), (i % 7).cast("string")).alias("text"),
        (70.0 * (i % 7 + 1)).alias("x"), (740.0 - 17 * (i % 40)).alias("y"), F.lit(24.0).alias("width"), F.lit(12.0).alias("height"), F.lit(10.0).alias("font_size"),
    )


def test_a_large_page_costs_no_square(spark):
    own = large_page(spark, 400_000)
    began = time.time()
    found = layout.line_numbers(own).groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("a"), F.max("y").alias("b")).collect()
    assert {(r["line"], r["n"], r["a"], r["b"]) for r in found} == {(k, 10_000, 740.0 - 17 * k, 740.0 - 17 * k) for k in range(40)}
    assert layout.spaced_text(own).select(F.size(F.split("text", "\n"))).first()[0] == 40
    order = layout.reading_order(own).agg(F.count_distinct("position"), F.max("position")).first()
    assert tuple(order) == (400_000, 400_000)
    assert time.time() - began < 60


def test_lines_follow_their_mean(spark):
    # Steps of 2.5 within half a height of the mean so far: a drifting line goes on until the next one is too far from its mean.
    ys = [700.0 - 2.5 * k for k in range(12)] + [500.0]
    got = layout.line_numbers(fragments(spark, [(1, 1, k, "t", 10.0 * k, y, 8.0, 100.0 if k < 12 else 12.0, 10.0) for k, y in enumerate(ys)]).withColumn("height", F.lit(12.0))).collect()
    tolerance, want, line, total, n = 0.5, {}, 0, 0.0, 0
    for k, y in enumerate(ys):
        if n and abs(y - total / n) > tolerance:
            line, total, n = line + 1, 0.0, 0
        total, n, want[k] = total + y, n + 1, line
    assert {r["seq"]: r["line"] for r in got} == want


def test_spaced_text_pads_to_each_place(spark):
    rows = [(1, 1, 0, "abcdefghijkl", 0.0, 700.0, 50.0, 10.0, 10.0), (1, 1, 1, "x", 30.0, 700.0, 5.0, 10.0, 10.0), (1, 1, 2, "é", 120.0, 700.0, 5.0, 10.0, 10.0), (1, 1, 3, "y", 132.0, 699.0, 5.0, 10.0, 10.0)]
    line = b""
    for _, _, _, t, x, *_ in rows:
        line += b" " * max(int(x // 6) - len(line), 0) + t.encode()
    assert layout.spaced_text(fragments(spark, rows)).first()["text"] == line.decode()


def test_columns_are_read_whole(spark):
    words = catalog._fragments(lambda t: spark.read.parquet(f"{SF}/{t}.parquet")).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("text")).alias("w"))
    want = {(r["doc_id"], r["page"]): r["w"] for r in words.collect()}
    got = {(r["doc_id"], r["page"]): r["text"] for r in catalog.QUERIES["column_text"](spark, SF).collect()}
    assert {k: sorted(t.split()) for k, t in got.items()} == want
    assert any("\n\n" in t for t in got.values())


def test_texts_over_each_other_stay_if_asked_for(spark):
    rows = [(1, 1, s, t, x, 700.0, 20.0, 10.0, 10.0) for s, t, x in ((0, "ab", 10.0), (1, "ab", 10.0), (2, "cd", 10.0), (3, "kern", 29.0), (4, "ed", 46.0))]
    own = fragments(spark, rows)
    assert documents.document_texts(own).first()["text"] == "ab cdkerned"
    assert documents.document_texts(own, documents.Options().with_repeats()).first()["text"] == "ab ab cdkerned"


def test_references_as_written(spark):
    page = "<html><head><title>a &lt;b&gt; &amp;quot; &quot;c&amp</title></head><body><h1>&lt;h &amp;&amp; &quot;x&amp</h1></body></html>"
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert html.html_head(df, references=False).first()["title"] == "a <b> &quot; &quot;c&amp"
    assert html.html_head(df).first()["title"] == 'a <b> &quot; "c&'
    assert [r["text"] for r in html.parse_html(df, "none", references=False).collect()] == ["<h && &quot;x&amp"]
    assert [r["text"] for r in html.parse_html(df, "none").collect()] == ['<h && "x&']


def test_six_decimals_of_floats(spark):
    v = [1 / 128, -1 / 128, 3 / 128, 0.1, -0.0, -1e-9, 1e-9, 2.0**23 + 1, 8388607.5, 1.5e12, -(2.0**60), float("nan"), float("inf"), float("-inf"), None]
    v += [float(x) for x in np.random.default_rng(7).integers(-(2**20), 2**20, 300) / 2**13]
    got = spark.createDataFrame([(v,)], "v array<float>").select(tables.embedding_text(F.col("v"))).first()[0]
    sql = "select '[' || array_to_string(list_transform(?::FLOAT[], lambda x: printf('%.6f', x::DOUBLE)), ',') || ']'"
    assert got == duckdb.execute(sql, [v]).fetchone()[0]
    assert got.startswith("[0.007812,-0.007812,0.023438,")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_steps_see_groups_once(spark):
    # Python isn't called for each page; sketches aren't held for each user; cells are looked up for each box.
    assert "CoGroups" not in plan(catalog.QUERIES["page_tables"](spark, SF))
    physical = catalog.QUERIES["approximate_distinct"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in physical.split("\n") if "keys=[event_type#" in x and "user_id#" in x.split("functions=")[0] and "approx" in x]
    rows = fragments(spark, [(1, 1, s, f"t{s}", 10.0 * (s % 2), 100.0 - 20 * (s // 2 % 2), 5.0, 5.0, 10.0) for s in range(8)])
    r, c = (grids.intervals(grids.boundaries(rows, a, layout.PAGE), layout.PAGE) for a in ("y", "x"))
    own = grids.cells(rows, r, c, layout.PAGE)
    lines = plan(own).split("\n")
    assert [i for i, x in enumerate(lines) if "Aggregate [doc_id" in x and "x#" in x.split("],")[0] and "width#" in x.split("],")[0]]
    assert sorted((x["row"], x["col"], x["text"], x["n"]) for x in own.collect()) == [(0, 0, "t2 t6", 2), (0, 2, "t3 t7", 2), (2, 0, "t0 t4", 2), (2, 2, "t1 t5", 2)]


def test_trees_go_without_a_search_for_cycles():
    seen, plain = [], html.tree

    def tree(text):
        root = plain(text)
        seen.append(weakref.ref(root))
        return root

    html.tree = tree
    gc.disable()
    try:
        assert html.elements_of("<body><p>a<p>b</body>") and html.head("<head><title>t</title></head>")["title"] == "t"
        assert [r() for r in seen] == [None, None]
    finally:
        html.tree = plain
        gc.enable()


def test_batches_become_objects_in_slices():
    batch = pa.record_batch({"k": list(range(1000)), "t": ["x" * 10_000] * 1000})
    parts = list(shared.slices([batch], "k", "t"))
    assert [k for p in parts for k in p[0]] == list(range(1000)) and max(len(p[0]) for p in parts) < 120
    assert list(shared.slices([batch.slice(0, 0)], "k")) == []


def test_sentence_ends_in_bytes():
    for t in ("", "Ab. Éc. D", "Élan. Vital! “Q?” Z", "No end"):
        assert sentences.byte_ends(t) == [len(t[:i].encode()) for i in sentences.sentence_ends(t)]
    began = time.time()
    assert len(sentences.byte_ends("Éab. " * 200_000)) == 199_999
    assert time.time() - began < 15

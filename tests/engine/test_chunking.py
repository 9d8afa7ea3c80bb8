import random

from folioflow.config import Limit, SizeConfig
from folioflow.functions import sentences as S
from folioflow.functions import text as X
from folioflow.operators import chunking as C
from folioflow.operators import layout, overlap
from folioflow.sources import html
from pyspark.sql import functions as F


def test_section_paths():
    paths = lambda *levels: C.section_paths([("abcd"[i], v) for i, v in enumerate(levels)])
    assert paths(1, 2, 2, 1) == [["a"], ["a", "b"], ["a", "c"], ["d"]]
    assert paths(1, 3, 3, 3) == [["a"], ["a", "b"], ["a", "b", "c"], ["a", "b", "d"]]
    assert paths(2, 1, 2) == [["a"], ["b"], ["b", "c"]]


def test_split_keeps_words_and_size():
    rng = random.Random(1)
    for size in (2010, 2050, 2099, 2100, 2300, 3999, 4001, 6050, 8123):
        text = " ".join(f"This is sentence number {i:03d}." for i in range(400))[:size]
        for t in (text, text.replace(" ", "é"), "x" * size, " ".join("é" * rng.randrange(1, 30) for _ in range(size // 20))):
            pieces = S.split_to_size(t)
            assert all(0 < len(p.encode()) <= 2000 for p in pieces)
            assert "".join("".join(pieces).split()) == "".join(t.split())
            if len(t.encode()) > 2100 and " " in t[:1900]:
                assert min(len(p.encode()) for p in pieces) >= 100


def test_sentence_splitters():
    assert S.strict_sentences("Dr. Who met J. Smith. It was 3.14 km away! He said no? Yes.") == ["Dr. Who met J. Smith.", "It was 3.14 km away!", "He said no?", "Yes."]
    assert S.loose_sentences("It is 3.14. ok then. A. Smith") == ["It is 3.", "14.", "ok then.", "A. Smith"]


def test_chapter_headings():
    for t in ("CHAPTER 1", "CHAPTER IV", "PART ONE", "APPENDIX A", "SECTION 3", "| CHAPTER 2 The Sea"):
        assert C.chapter_heading(t), t
    for t in ("Chapters are nice", "The chapter 1 of this", "In part one we saw", "Sections", "appendixes", "A part"):
        assert C.chapter_heading(t) is None, t
    assert C.chapter_heading("PART TWO Home. Then he left.")[1:] == ("Then he left.", 1)


def element(kind, text=None, page=1, **more):
    return {"page": page, "type": kind, "text": text, "level": None, "ordered": None, "items": None, "rows": None, "alt_text": None} | more


def test_headings_join_and_small_chunks_merge():
    out = C.Chunker(SizeConfig()).chunk([element("heading", "Top", level=1), element("heading", "Sub", level=2), element("paragraph", "word " * 60), element("paragraph", "tail"), element("list", items=[{"text": "a", "level": 0}, {"text": "b", "level": 1}])])
    assert [c["section_path"] for c in out] == [["Top", "Sub"]]
    assert out[0]["text"].startswith("Top\n\nSub\n\nword") and out[0]["text"].endswith("tail\n\n- a\n  - b")
    assert out[0]["element_types"] == ["paragraph", "heading", "list"] and out[0]["has_list"] and out[0]["total_chunks"] == 1


def test_chunks_of_documents(spark):
    long = "\n".join(f"Sentence number {i} stands here. And one more follows it." for i in range(300))
    df = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "CHAPTER 1 Start\nBody text " + "w " * 80)], "doc_id long, text string")
    rows = C.chunk_documents(df).collect()
    one = [r for r in rows if r["doc_id"] == 1]
    assert [r["chunk_index"] for r in one] == list(range(len(one))) and max(r["char_count"] for r in one) <= 2000
    assert "".join("".join(r["text"] for r in one).split()) == "".join(long.split())
    assert not [r for r in rows if r["doc_id"] in (2, 3)]
    four = [r for r in rows if r["doc_id"] == 4]
    assert four[0]["section_title"].startswith("CHAPTER 1") and four[0]["text_with_context"].startswith("[CHAPTER 1")


def test_pages_end_blocks(spark):
    out = C.Chunker(SizeConfig(merge_small=False)).chunk([element("paragraph", "one", 1), element("paragraph", "two", 2)])
    assert [(c["text"], c["page_start"]) for c in out] == [("one", 1), ("two", 2)]


PAGE = """<body><div id=wrap><nav class=x><a href=1>Home</a></nav><header>Top <p>Site</p></header><main><h1>Title</h1><p>One<br>two <b>bold<p>Three
<ul><li>a<ul><li>b</ul><li>c</ul><ol><li>n</ol><table><thead><tr><th>H<th>I</thead><tr><td rowspan=2>1<td>2</table><pre>code</pre><blockquote>q</blockquote>
<div class="sidebar"><p>side</p></div><div><a href=1>l1</a> <a href=2>l2</a> <a href=3>l3</a> <a href=4>l4</a> x</div></main></div></body>"""


def test_web_pages_by_mode():
    kinds = {m: [e["type"] for e in html.elements_of(PAGE, m)] for m in html.MODES}
    texts = {m: " ".join((e.get("text") or "") for e in html.elements_of(PAGE, m)) for m in html.MODES}
    assert kinds["none"][-7:] == ["list", "list", "table", "code", "blockquote", "paragraph", "paragraph"]
    assert "Site" in texts["none"] and "Site" not in texts["explicit"]
    assert "side" in texts["explicit"] and "side" not in texts["standard"]
    assert "l4" in texts["standard"] and "l4" not in texts["aggressive"]
    found = html.elements_of(PAGE, "standard")
    assert [(i["text"], i["level"]) for e in found if e["type"] == "list" for i in e["items"]] == [("a", 0), ("b", 1), ("c", 0), ("n", 0)]
    table = next(e for e in found if e["type"] == "table")["rows"]
    assert table[0][0]["is_header"] and table[1][0]["row_span"] == 2
    assert html.head("<head><title> T </title><meta name=a content=b><meta property=a content=c></head>") == {"title": "T", "meta": {"a": "c"}}


def test_overlap_of_neighbours(spark):
    df = spark.createDataFrame([(1, 0, "First one here. Second one there. Third one."), (1, 1, "Next."), (2, 0, "x")], "k long, n long, text string")
    rows = {(r["k"], r["n"]): r for r in overlap.with_previous(df, "k", "n").collect()}
    assert rows[1, 1]["prefix"] == "Second one there. Third one." and rows[1, 1]["text_with_overlap"].endswith("\n\nNext.")
    assert rows[2, 0]["prefix"] == "" and rows[2, 0]["text_with_overlap"] == "x"


def test_repeated_headers_are_found(spark):
    rows = [(1, p, i, t, 50.0, y, 100.0, 10.0, 10.0) for p in range(1, 5) for i, (t, y) in enumerate([("Annual report", 760.0), (f"unique {p} text {p * 7}x{'y' * p}", 400.0), (f"Page {p}", 20.0)])]
    df = spark.createDataFrame(rows, "doc_id long, page long, seq int, text string, x double, y double, width double, height double, font_size double")
    got = {(r["region"], r["shape"]) for r in layout.header_footer(df).collect()}
    assert got == {("header", "Annual report"), ("footer", "Page #")}


def test_text_functions(spark):
    df = spark.createDataFrame([("XIV",), ("iv",), ("MMXXVI",)], "t string")
    assert [r[0] for r in df.select(X.roman_value(F.col("t"))).collect()] == [14, 4, 2026]
    df = spark.createDataFrame([("2. two",), ("- dash",), ("[x] done",), ("Term: meaning",), ("plain text",), ("  \t- deep",)], "t string")
    assert [tuple(r) for r in df.select(X.list_kind(F.col("t")), X.list_marker(F.col("t")), X.indent_level(F.col("t"))).collect()] == [
        ("ordered", "2.", 0), ("unordered", "-", 0), ("checklist", "[x]", 0), ("definition", "", 0), ("", "", 0), ("unordered", "-", 3),
    ]
    assert SizeConfig.by_tokens(512, 8000).most == Limit(8000, "tokens", soft=False)


def test_section_chunks():
    from folioflow.operators import sections as SC

    body = [element("heading", "A", level=1), element("paragraph", "One. " * 30), element("paragraph", "These are the items:"), element("list", items=[{"text": "x" * 50, "level": 0}] * 2), element("heading", "deep", level=4), element("heading", "B", level=2), element("paragraph", "Tail.")]
    out = SC.section_chunks(body, SC.SectionConfig(most=200, least=20))
    assert [c["section_path"] for c in out] == [["A"], ["A"], ["A", "B"]]
    assert all(len(c["text"].encode()) <= 203 for c in out)
    assert "These are the items:\n\n- x" in out[1]["text"] and out[1]["has_list"]
    assert out[2]["text"] == "B\n\nTail." and out[2]["level"] == "section"
    assert SC.section_chunks([], SC.SectionConfig()) == []


def test_sentence_end_near_an_offset():
    from folioflow.operators.overlap import end_near

    data = b"One two. Three four five! Six"
    assert [end_near(data, k) for k in (0, 8, 10, 24, 26, 28, 29, 99)] == [8, 8, 8, 25, 25, 25, 29, 29]
    words = b"x" * 130 + b" " + b"y" * 300
    assert end_near(words, 125) == 130 and end_near(words, 132) == 130 and end_near(words, 300) == 300

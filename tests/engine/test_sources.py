import io
import zipfile

import pytest
from folioflow import streaming
from folioflow.sources import detect, office
from pyspark.sql import functions as F

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def packed(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


P = '<w:p><w:pPr>{}</w:pPr><w:r><w:t>{}</w:t></w:r></w:p>'
NUM = '<w:numPr><w:ilvl w:val="{}"/><w:numId w:val="1"/></w:numPr>'
DOCX = archive(
    {
        "[Content_Types].xml": "<Types/>",
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style><w:style w:styleId="K"><w:name w:val="Kid"/><w:basedOn w:val="H"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
        "word/document.xml": f"<w:document {W}><w:body>"
        + P.format('<w:pStyle w:val="K"/>', "Head") + P.format("", "Text") + P.format(NUM.format(0), "one") + P.format(NUM.format(1), "two")
        + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
    }
)
XLSX = archive(
    {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><r><t>Na</t></r><r><t>me</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>x</t></is></c></row><row r="3"><c r="B3"><f>1+1</f><v>2</v></c><c r="C3" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="D2:E3"/></mergeCells></worksheet>',
    }
)
A = 'xmlns:p="p" xmlns:a="a"'
PPTX = archive(
    {
        "ppt/slides/slide2.xml": f'<p:sld {A}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>Second</a:t></a:r></a:p></p:sp></p:sld>',
        "ppt/slides/slide1.xml": f'<p:sld {A}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>First</a:t></a:r></a:p></p:sp><p:sp><p:nvPr/><a:p><a:pPr lvl="1"><a:buChar/></a:pPr><a:r><a:t>dot</a:t></a:r></a:p></p:sp><p:sp><p:nvPr><p:ph type="sldNum"/></p:nvPr><a:p><a:r><a:t>9</a:t></a:r></a:p></p:sp></p:sld>',
    }
)
ODT = archive(
    {
        "mimetype": "application/vnd.oasis.opendocument.text",
        "content.xml": '<d xmlns:o="o" xmlns:t="t" xmlns:b="b"><o:body><o:text><t:h t:outline-level="2">Head</t:h><t:p>a<t:s t:c="2"/>b</t:p><t:list><t:list-item><t:p>i</t:p><t:list><t:list-item><t:p>j</t:p></t:list-item></t:list></t:list-item></t:list><b:table><b:table-row><b:table-cell><t:p>c</t:p></b:table-cell></b:table-row></b:table></o:text></o:body></d>',
    }
)
EPUB = archive(
    {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>',
        "O/p.opf": '<package xmlns:dc="dc"><metadata><dc:title>Book</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator></metadata><manifest><item id="c1" href="1.xhtml"/><item id="c2" href="2.xhtml"/></manifest><spine><itemref idref="c2"/><itemref idref="no"/><itemref idref="c1"/></spine></package>',
        "O/1.xhtml": "<body><h1>One</h1></body>",
        "O/2.xhtml": "<body><p>Two</p></body>",
    }
)


def brief(es):
    return [(e.get("page", 1), e["type"], e.get("text") or [i["text"] for i in e.get("items") or []] or [[c["text"] for c in r] for r in e["rows"]]) for e in es]


def test_office_files():
    assert brief(office.docx(DOCX)) == [(1, "heading", "Head"), (1, "paragraph", "Text"), (1, "list", ["one", "two"]), (1, "table", [["a", "b"]])]
    assert next(e for e in office.docx(DOCX) if e["type"] == "list")["ordered"]
    assert brief(office.xlsx(XLSX)) == [(1, "table", [["Name", "x"], ["2", "TRUE"]])]
    assert [c["type"] for c in office.xlsx_cells(XLSX)] == ["string", "string", "number", "boolean"]
    assert brief(office.pptx(PPTX)) == [(1, "heading", "First"), (1, "list", ["dot"]), (2, "heading", "Second")]
    assert brief(office.odt(ODT)) == [(1, "heading", "Head"), (1, "paragraph", "a  b"), (1, "list", ["i", "j"]), (1, "table", [["c"]])]
    assert brief(office.epub(EPUB)) == [(1, "paragraph", "Two"), (2, "heading", "One")]
    assert office.epub_metadata(EPUB)["creators"] == ["A", "B"]
    with pytest.raises(ValueError):
        list(office.epub(archive({"META-INF/rights.xml": "<x/>"})))


def test_files_by_name_and_content(spark, tmp_path):
    for name, data in {"a.docx": DOCX, "b.XLSX": XLSX, "c.pptx": PPTX, "d.odt": ODT, "e.epub": EPUB, "f.htm": b"<!DOCTYPE html><body><p>hi</p>", "g.docx": b"no zip", "h.txt": b"x", "i.pdf": DOCX}.items():
        (tmp_path / name).write_bytes(data)
    files = office.read_files(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("found", detect.by_content(F.col("content")))
    got = {r["name"]: (r["format"], r["found"]) for r in files.select("name", "format", "found").collect()}
    assert got["b.XLSX"] == ("xlsx", "xlsx") and got["f.htm"] == ("html", "html") and got["h.txt"] == ("unknown", "unknown") and got["e.epub"] == ("epub", "epub")
    kinds = {r["name"]: r["n"] for r in office.file_elements(files).join(files.select("doc_id", "name"), "doc_id").groupBy("name").agg(F.collect_list("type").alias("n")).collect()}
    assert got["i.pdf"] == ("mismatch", "docx") and kinds["i.pdf"] == ["warning"]
    assert kinds["g.docx"] == ["warning"] and len(kinds["a.docx"]) == 4 and "h.txt" not in kinds
    assert office.select_pages(office.file_elements(files), [2, 2]).count() == 2
    with pytest.raises(ValueError):
        office.select_pages(files, [0])


def test_stream_of_documents(spark, tmp_path):
    spark.createDataFrame([(1, "Some text here.\nMore text.", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/in")
    chunks = streaming.chunk_stream(streaming.document_stream(spark, f"{tmp_path}/in"))
    q = streaming.write_stream(chunks, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    assert streaming.event_counts(events).isStreaming


def test_repeated_cells_and_rows_of_odt():
    cell = lambda t, n=1: f'<b:table-cell b:number-columns-repeated="{n}">' + (f"<t:p>{t}</t:p>" if t else "") + "</b:table-cell>"
    rows = f"<b:table-row>{cell('a', 60)}{cell('', 3)}{cell('b')}{cell('', 16000)}</b:table-row>"
    rows += f'<b:table-row b:number-rows-repeated="2">{cell("c")}</b:table-row><b:table-row b:number-rows-repeated="9999">{cell("", 16000)}</b:table-row>'
    made = archive({"content.xml": f'<d xmlns:o="o" xmlns:t="t" xmlns:b="b"><o:body><o:text><b:table>{rows}</b:table></o:text></o:body></d>'})
    table = next(e for e in office.odt(made) if e["type"] == "table")["rows"]
    assert [c["text"] for c in table[0]] == ["a"] * 60 + [""] * 3 + ["b"]
    assert [[c["text"] for c in r] for r in table[1:3]] == [["c"], ["c"]]

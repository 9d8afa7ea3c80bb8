import hashlib
import zlib

import pytest

from folioflow.operators import layout
from folioflow.sources import crypt, pdf


def build(*contents, font=b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/FirstChar 32/Widths[250 250]>>", more=b"", trailer=b""):
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[" + b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(contents))) + b"]/Count 1/MediaBox[0 0 612 792]/Resources<</Font<</F1 3 0 R>>/XObject<</X 4 0 R>>>>>>", font]
    form = b"BT /F1 8 Tf 5 5 Td (form) Tj ET"
    objects.append(b"<</Subtype/Form/Matrix[1 0 0 1 100 100]/Length %d>>\nstream\n%s\nendstream" % (len(form), form))
    for i, c in enumerate(contents):
        z = zlib.compress(c)
        objects.append(b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (6 + 2 * i))
        objects.append(b"<</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream" % (len(z), z))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + more + b"trailer <</Root 1 0 R" + trailer + b">>"


def test_text_operators():
    found = list(pdf.fragments_of(build(b"BT /F1 12 Tf 72 700 Td (Hello \\(you\\) \\351) Tj 0 -14 TD [(Wo) -250 (rld)] TJ T* (next) Tj ET q 2 0 0 2 0 0 cm BT /F1 10 Tf 1 0 0 1 50 60 Tm <48 69> Tj ET Q /X Do", b"BT /F1 9 Tf (two) Tj ET")))
    assert [(f["page"], f["text"]) for f in found] == [(1, "Hello (you) é"), (1, "Wo"), (1, "rld"), (1, "next"), (1, "Hi"), (1, "form"), (2, "two")]
    assert (found[0]["x"], found[0]["y"], found[0]["font_size"]) == (72, 700, 12)
    assert (found[1]["y"], found[3]["y"]) == (686, 672)
    assert (found[4]["x"], found[4]["y"], found[4]["font_size"]) == (100, 120, 20)
    assert (found[5]["x"], found[5]["y"]) == (105, 105)


def test_unicode_map_and_wide_codes():
    cmap = b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0003> <00E90042> endbfrange"
    font = b"<</Type/Font/Subtype/Type0/BaseFont/F/ToUnicode 90 0 R/DescendantFonts[<</DW 600/W[1[700 800]]>>]>>"
    more = b"90 0 obj <</Length %d>>\nstream\n%s\nendstream endobj\n" % (len(cmap), cmap)
    f = list(pdf.fragments_of(build(b"BT /F1 10 Tf <000100020003> Tj ET", font=font, more=more)))[0]
    assert f["text"] == "AéBéC" and abs(f["width"] - 21) < 1e-9


def test_filters():
    assert pdf.run_lengths(b"\x02abc\xfed\x80") == b"abcddd"
    assert pdf.unpredicted(b"\x02\x01\x02\x02\x01\x01", {"Predictor": 12, "Columns": 2}) == b"\x01\x02\x02\x03"
    assert pdf.unpredicted(b"\x01\x05\x01", {"Predictor": 12, "Columns": 2}) == b"\x05\x06"


def test_files_to_lines(spark):
    good = build(b"BT /F1 12 Tf 72 700 Td (One line) Tj 100 0 Td (goes on) Tj -100 -20 Td (Next line) Tj ET")
    df = spark.createDataFrame([(1, "pdf", bytearray(good)), (2, "pdf", bytearray(build(b"", trailer=b"/Encrypt 9 0 R"))), (3, "html", bytearray(b"x"))], "doc_id long, format string, content binary")
    frags = pdf.pdf_fragments(df)
    assert [r["text"] for r in frags.where("doc_id = 2").collect()] == ["warning: the file is encrypted, by version 0, revision 2"]
    assert [r["text"] for r in layout.lines(frags.where("doc_id = 1")).orderBy("line").collect()] == ["One line goes on", "Next line"]


def test_headers_and_footers_leave_the_body(spark):
    from folioflow.plans import documents

    row = lambda page, seq, text, x, y: (7, page, seq, text, float(x), float(y), 40.0, 10.0, 10.0, "F")
    rows = []
    for p in (1, 2, 3):
        rows += [row(p, 0, "My Report", 72, 770), row(p, 1, f"{2018 + p}", 72, 500), row(p, 2, "My Report", 72, 400), row(p, 3, f"{p}", 300, 30)]
        rows += [row(p, 4, f"item {p}", 72 + 20 * p, 80)]  # in the band, but at no steady place
    df = spark.createDataFrame(rows, "doc_id long, page int, seq long, text string, x double, y double, width double, height double, font_size double, font_name string")
    text = lambda **o: " ".join(r["text"] for r in documents.fragment_elements(df, documents.Options(**o)).orderBy("page", "pos").collect()).split()
    both = text(headers=False, footers=False)
    assert both == [w for p in (1, 2, 3) for w in (f"{2018 + p}", "My", "Report", "item", f"{p}")]
    assert text(footers=False).count("Report") == 6 and text(headers=False).count("Report") == 3
    assert sorted((r["region"], r["shape"]) for r in layout.header_footer(df).collect()) == [("footer", "#"), ("header", "My Report")]


def test_files_end_to_end(spark, tmp_path):
    from folioflow.plans import documents
    from tests.engine.test_sources import DOCX

    page = lambda n: b"BT /F1 10 Tf 72 770 Td (My Report) Tj 0 -30 Td 0 -30 Td /F1 24 Tf (Big Title %s) Tj /F1 10 Tf 0 -60 Td (Some words of text in a line that is long) Tj 0 -12 Td (and its next line which is just as long) Tj ET" % n
    (tmp_path / "a.pdf").write_bytes(build(page(b"a"), page(b"b")))
    (tmp_path / "b.docx").write_bytes(DOCX)
    es = documents.open_files(spark, str(tmp_path), documents.Options(headers=False))
    pdf_ids = [r["doc_id"] for r in es.where("page = 2").select("doc_id").distinct().collect()]
    found = [(r["page"], r["type"], r["text"]) for r in es.where(es["doc_id"].isin(pdf_ids)).orderBy("page", "pos").collect()]
    body = "Some words of text in a line that is long and its next line which is just as long"
    assert found == [(1, "heading", "Big Title a"), (1, "paragraph", body), (2, "heading", "Big Title b"), (2, "paragraph", body)]
    assert documents.markdown(es).where("markdown like '# Big Title a%'").count() == 1
    assert documents.chunks(es).where("has_table").count() == 1
    assert {r["page"] for r in documents.open_files(spark, str(tmp_path), documents.Options(pages=(2,))).collect()} == {2}


def referenced(text=b"old", more=b"", size=8):
    """A file with a cross-reference table, and where its section starts."""
    body, at = build(b"BT /F1 12 Tf 72 700 Td (%s) Tj ET" % text)[: -len(b"trailer <</Root 1 0 R>>")], {}
    for m in pdf.OBJECT.finditer(body):
        at[int(m[1])] = m.start()
    start = len(body)
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + b"".join(b"%010d 00000 n \n" % at[n] for n in sorted(at))
    return body + table + b"trailer\n<</Size %d/Root 1 0 R%s>>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, more, start), start


def texts(content):
    return [f["text"] for f in pdf.fragments_of(content)]


def test_cross_reference_tables_and_updates():
    first, start = referenced()
    assert texts(first) == ["old"]
    # An update moves the contents and frees nothing else; bytes that look like an object don't count.
    z = zlib.compress(b"BT /F1 12 Tf 72 700 Td (new) Tj ET")
    at = len(first)
    update = b"6 0 obj\n<</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream\nendobj\n" % (len(z), z)
    section = len(first) + len(update)
    second = first + update + b"xref\n6 1\n%010d 00000 n \ntrailer\n<</Size 7/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF\n6 0 obj (a lie) endobj\n" % (at, start, section)
    assert texts(second) == ["new"]
    freed = first + b"xref\n6 1\n0000000000 00001 f \ntrailer\n<</Size 7/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF\n" % (start, len(first))
    assert texts(freed) == []
    # Wrong offsets, or a section that isn't there: the objects are searched for.
    assert texts(second.replace(b"startxref\n%d" % section, b"startxref\n3")) == []  # the last object 6 of the file is a string
    assert texts(first.replace(b"startxref\n%d" % start, b"startxref\n3")) == ["old"]
    assert pdf.Pdf(second).section(start)[0][0] == (0,)


def test_cross_reference_streams():
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[5 0 R]/Count 1/Resources<</Font<</F1 3 0 R>>>>>>", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"]
    head, body = [], b""
    for n, o in enumerate(objects, 1):
        head += [b"%d %d" % (n, len(body))]
        body += o + b" "
    packed = zlib.compress(b" ".join(head) + b" " + body)
    content = b"BT /F1 10 Tf (packed) Tj ET"
    out, at = b"%PDF-1.5\n", {}
    for n, o in (
        (4, b"<</Type/ObjStm/N 3/First %d/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (len(b" ".join(head)) + 1, len(packed), packed)),
        (5, b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 9 9]/Contents 6 0 R>>"), (6, b"<</Length %d>>\nstream\n%s\nendstream" % (len(content), content)),
    ):
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    rows = [(0, 0, 0), *[(2, 4, i) for i in range(3)], *[(1, at[n], 0) for n in (4, 5, 6)], (1, len(out), 0)]
    data = zlib.compress(b"".join(bytes([k]) + a.to_bytes(3, "big") + bytes([g]) for k, a, g in rows))
    start = len(out)
    out += b"7 0 obj\n<</Type/XRef/Size 8/W[1 3 1]/Root 1 0 R/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (len(data), data, start)
    assert texts(out) == ["packed"]
    assert pdf.Pdf(out).packed == {1: (4, 0), 2: (4, 1), 3: (4, 2)}
    assert texts(out.replace(b"startxref", b"startnone")) == ["packed"]


def test_damaged_streams_keep_what_comes_before():
    text = b"".join(b"line %d of some text\n" % (i * 7919 % 1000) for i in range(2000))
    whole = zlib.compress(text)
    assert pdf.inflated(whole) == text
    kept = pdf.inflated(whole[: len(whole) // 2] + b"\xff" * 40 + whole[len(whole) // 2 + 40 :])
    assert len(kept) > len(text) // 4 and text.startswith(kept[: len(text) // 4])


def test_ciphers():
    assert crypt.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"
    block = crypt.aes_cbc(bytes(range(16)), bytes(16) + bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a"))
    assert block.hex() == "00112233445566778899aabbccddeeff"
    assert crypt.aes_cbc(bytes(range(32)), bytes(16) + bytes.fromhex("8ea2b7ca516745bfeafc49904b496089")).hex() == "00112233445566778899aabbccddeeff"


@pytest.mark.parametrize("opens", [True, False])
def test_files_with_an_empty_password(opens):
    owner, number, file_id = bytes(range(32)), -44, b"0123456789abcdef"
    key = hashlib.md5(crypt.PAD + owner + (number & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    told = crypt.rc4(key, hashlib.md5(crypt.PAD + file_id).digest())
    for i in range(1, 20):
        told = crypt.rc4(bytes(c ^ i for c in key), told)
    user = told + bytes(16) if opens else bytes(32)
    own = hashlib.md5(key + (6).to_bytes(3, "little") + (0).to_bytes(2, "little")).digest()
    content = crypt.rc4(own, b"BT /F1 10 Tf (secret) Tj ET")
    encrypt = b"8 0 obj <</Filter/Standard/V 2/R 3/Length 128/P -44/O<%s>/U<%s>>> endobj " % (owner.hex().encode(), user.hex().encode())
    made = build(b"x", more=encrypt, trailer=b"/Encrypt 8 0 R/ID[<%s><00>]" % file_id.hex().encode())
    begin, end = made.index(b"6 0 obj"), made.index(b"8 0 obj")
    made = made[:begin] + b"6 0 obj\n<</Length %d>>\nstream\n%s\nendstream\nendobj\n" % (len(content), content) + made[end:]
    if opens:
        assert texts(made) == ["secret"]
    else:
        with pytest.raises(ValueError, match="password"):
            texts(made)

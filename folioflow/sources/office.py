"""Office files and e-books as elements: DOCX, ODT, XLSX, PPTX and EPUB, each a zip archive of XML."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.schemas import ELEMENTS, FIELDS
from folioflow.sources import html
from folioflow.sources.detect import by_name, checked


def tag(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def attr(node: ET.Element, name: str, default: str = "") -> str:
    return next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), default)


def kids(node: ET.Element, name: str) -> list[ET.Element]:
    return [k for k in node if tag(k) == name]


def below(node: ET.Element, name: str) -> Iterator[ET.Element]:
    return (k for k in node.iter() if tag(k) == name)


def first(node: ET.Element | None, name: str) -> ET.Element | None:
    return next(below(node, name), None) if node is not None else None


class Archive:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def text(self, name: str) -> str:
        return self.zip.read(name).decode("utf-8", "replace") if name in self.names else ""

    def relations(self, name: str) -> dict[str, str]:
        """Targets by id of a part's relations."""
        folder, base = posixpath.split(name)
        rels = self.xml(f"{folder}/_rels/{base}.rels")
        return {attr(r, "Id"): posixpath.normpath(posixpath.join(folder, attr(r, "Target"))).lstrip("/") for r in (rels if rels is not None else []) if tag(r) == "Relationship"}


def cell(text: str, head: bool = False, rows: int = 1, cols: int = 1) -> dict:
    return {"text": text, "row_span": rows, "col_span": cols, "is_header": head}


def items(found: list[tuple[str, int, str]]) -> list[dict]:
    return [{"text": t, "level": level, "bullet": b} for t, level, b in found]


class Docx:
    """Paragraphs, headings, lists and tables of a DOCX file in the order of its body."""

    def __init__(self, content: bytes):
        self.zip = Archive(content)
        styles = self.zip.xml("word/styles.xml")
        self.styles = {attr(s, "styleId"): s for s in (below(styles, "style") if styles is not None else [])}
        self.ordered = self._numbering()

    def _numbering(self) -> dict[str, bool]:
        root = self.zip.xml("word/numbering.xml")
        if root is None:
            return {}
        kinds = {attr(a, "abstractNumId"): attr(f, "val") for a in kids(root, "abstractNum") if (f := first(a, "numFmt")) is not None}
        return {attr(n, "numId"): kinds.get(attr(a, "val"), "bullet") != "bullet" for n in kids(root, "num") if (a := first(n, "abstractNumId")) is not None}

    def level(self, p: ET.Element) -> int:
        """Heading level by outline level, style name along the chain of bases, or large bold type; 0 for none."""
        style = first(first(p, "pPr"), "pStyle")
        outline = first(first(p, "pPr"), "outlineLvl")
        if outline is not None and attr(outline, "val").isdigit():
            return min(int(attr(outline, "val")) + 1, 6)
        seen, sid = set(), attr(style, "val") if style is not None else ""
        while sid and sid not in seen:
            seen.add(sid)
            s = self.styles.get(sid)
            name = (attr(n, "val") if s is not None and (n := first(s, "name")) is not None else sid).lower()
            if m := re.match(r"heading\s*(\d)", name) or re.match(r"heading\s*(\d)", sid.lower()):
                return min(int(m[1]), 6)
            if name == "title":
                return 1
            o = first(s, "outlineLvl")
            if o is not None and attr(o, "val").isdigit() and int(attr(o, "val")) < 9:
                return min(int(attr(o, "val")) + 1, 6)
            base = first(s, "basedOn")
            sid = attr(base, "val") if base is not None else ""
        return 0

    @staticmethod
    def text(p: ET.Element) -> str:
        return "".join(n.text or "" if tag(n) == "t" else "\t" if tag(n) == "tab" else "\n" if tag(n) in ("br", "cr") else "" for n in p.iter()).strip()

    def table(self, t: ET.Element) -> list[list[dict]]:
        rows = []
        for i, r in enumerate(kids(t, "tr")):
            row = []
            for c in kids(r, "tc"):
                pr = first(c, "tcPr")
                span = first(pr, "gridSpan")
                merge = first(pr, "vMerge")
                again = merge is not None and attr(merge, "val", "continue") != "restart"
                text = "" if again else "\n".join(x for p in below(c, "p") if (x := self.text(p)))
                row.append(cell(text, i == 0 and first(first(r, "trPr"), "tblHeader") is not None, 1, int(attr(span, "val", "1")) if span is not None else 1))
            rows.append(row)
        return [r for r in rows if r]

    def elements(self) -> Iterator[dict]:
        doc = self.zip.xml("word/document.xml")
        body = first(doc, "body")
        held: list[tuple[str, int, str]] = []
        number = ""

        def flush() -> Iterator[dict]:
            if held:
                yield {"page": 1, "type": "list", "items": items(held), "ordered": self.ordered.get(number, False)}
                held.clear()

        for n in body if body is not None else []:
            if tag(n) == "p":
                text, level = self.text(n), self.level(n)
                num = first(first(n, "pPr"), "numPr")
                nid = attr(x, "val") if num is not None and (x := first(num, "numId")) is not None else ""
                if text and nid and nid != "0" and not level:
                    if nid != number:
                        yield from flush()
                    number = nid
                    ilvl = first(num, "ilvl")
                    held.append((text, int(attr(ilvl, "val", "0")) if ilvl is not None else 0, ""))
                    continue
                yield from flush()
                if text:
                    yield {"page": 1, "type": "heading" if level else "paragraph", "text": text, "level": level or None}
            elif tag(n) == "tbl":
                yield from flush()
                if rows := self.table(n):
                    yield {"page": 1, "type": "table", "rows": rows}
        yield from flush()


def docx(content: bytes) -> Iterator[dict]:
    return Docx(content).elements()


def odt(content: bytes) -> Iterator[dict]:
    """Paragraphs, headings, lists and tables of an ODT file."""

    def text(n: ET.Element) -> str:
        out = [n.text or ""]
        for k in n:
            out.append({"s": " " * int(attr(k, "c", "1") or 1), "tab": "\t", "line-break": "\n"}.get(tag(k)) or ("" if tag(k) in ("note", "annotation") else text(k)))
            out.append(k.tail or "")
        return "".join(out)

    def listed(n: ET.Element, level: int) -> list[tuple[str, int, str]]:
        out = []
        for it in kids(n, "list-item"):
            for k in it:
                if tag(k) in ("p", "h") and (t := text(k).strip()):
                    out.append((t, level, ""))
                elif tag(k) == "list":
                    out += listed(k, level + 1)
        return out

    def walk(n: ET.Element) -> Iterator[dict]:
        for k in n:
            kind = tag(k)
            if kind == "h" and (t := text(k).strip()):
                yield {"page": 1, "type": "heading", "text": t, "level": int(attr(k, "outline-level", "1") or 1)}
            elif kind == "p" and (t := text(k).strip()):
                yield {"page": 1, "type": "paragraph", "text": t}
            elif kind == "list" and (found := listed(k, 0)):
                yield {"page": 1, "type": "list", "items": items(found), "ordered": False}
            elif kind == "table":
                rows = []
                heads = {id(r) for h in below(k, "table-header-rows") for r in below(h, "table-row")}
                for r in below(k, "table-row"):
                    # Cells and rows can be said to repeat; empty ones at the end only fill the sheet.
                    row: list[tuple] = []
                    for c in r:
                        if tag(c) in ("table-cell", "covered-table-cell"):
                            value = "\n".join(text(p) for p in below(c, "p")).strip()
                            made = cell(value, id(r) in heads, int(attr(c, "number-rows-spanned", "1")), int(attr(c, "number-columns-spanned", "1")))
                            row.append((made, int(attr(c, "number-columns-repeated", "1")), bool(value)))
                    while len(row) > 1 and not row[-1][2] and row[-1][1] > 1:
                        row.pop()
                    own = [made for made, n, full in row for _ in range(n)]
                    rows += [own] * (int(attr(r, "number-rows-repeated", "1")) if any(full for _, _, full in row) else 1)
                if rows := [r for r in rows if r]:
                    yield {"page": 1, "type": "table", "rows": rows}
            elif kind in ("section", "text"):
                yield from walk(k)

    return walk(first(Archive(content).xml("content.xml"), "body"))


def cell_reference(ref: str) -> tuple[int, int]:
    """0-based column and row of a reference like AB12."""
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref)
    if not m:
        raise ValueError(ref)
    column = 0
    for c in m[1].upper():
        column = column * 26 + ord(c) - 64
    return column - 1, int(m[2]) - 1


def xlsx_cells(content: bytes) -> Iterator[dict]:
    """Cells of all sheets: sheet, row, col, value, type, formula; a merged range's other cells are left out."""
    z = Archive(content)
    shared = z.xml("xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in below(s, "t")) for s in (kids(shared, "si") if shared is not None else [])]
    book, rels = z.xml("xl/workbook.xml"), z.relations("xl/workbook.xml")
    for sheet in below(book, "sheet"):
        root = z.xml(rels.get(attr(sheet, "id"), ""))
        if root is None:
            continue
        covered = set()
        for m in below(root, "mergeCell"):
            a, _, b = attr(m, "ref").partition(":")
            (x1, y1), (x2, y2) = cell_reference(a), cell_reference(b or a)
            covered |= {(x, y) for x in range(x1, x2 + 1) for y in range(y1, y2 + 1)} - {(x1, y1)}
        for c in below(root, "c"):
            x, y = cell_reference(attr(c, "r"))
            kind, v, f = attr(c, "t", "n"), first(c, "v"), first(c, "f")
            value = v.text or "" if v is not None else ""
            if kind == "s":
                value = strings[int(value)] if value.isdigit() and int(value) < len(strings) else ""
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in below(c, "t"))
            elif kind == "b":
                value = "TRUE" if value == "1" else "FALSE"
            names = {"s": "string", "str": "string", "inlineStr": "string", "b": "boolean", "e": "error", "n": "number"}
            if (x, y) not in covered:
                yield {"sheet": attr(sheet, "name"), "row": y, "col": x, "value": value, "type": names.get(kind, "number"), "formula": f.text if f is not None else None}


def xlsx(content: bytes) -> Iterator[dict]:
    """Each sheet a page with one table over the cells that aren't empty; its first row is the header."""
    sheets: dict[str, dict] = {}
    for c in xlsx_cells(content):
        if c["value"]:
            sheets.setdefault(c["sheet"], {})[c["row"], c["col"]] = c["value"]
    for page, cells in enumerate(sheets.values(), 1):
        ys, xs = sorted({y for y, _ in cells}), sorted({x for _, x in cells})
        rows = [[cell(cells.get((y, x), ""), y == ys[0]) for x in range(xs[0], xs[-1] + 1)] for y in range(ys[0], ys[-1] + 1)]
        yield {"page": page, "type": "table", "rows": rows}


def pptx(content: bytes) -> Iterator[dict]:
    """Each slide a page: its title, then bullets or paragraphs, then tables, then notes."""
    z = Archive(content)
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    slides = sorted((n for n in z.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
    for page, name in enumerate(slides, 1):
        root, titled, tables = z.xml(name), False, []
        for shape in below(root, "sp"):
            place = first(first(shape, "nvPr"), "ph")
            kind = attr(place, "type", "body") if place is not None else "body"
            if kind in ("ftr", "dt", "sldNum", "hdr"):
                continue
            paras = []
            for p in below(shape, "p"):
                text = "".join(t.text or "" for t in below(p, "t")).strip()
                pr = first(p, "pPr")
                mark = pr is not None and (first(pr, "buChar") is not None or first(pr, "buAutoNum") is not None)
                numbered = pr is not None and first(pr, "buAutoNum") is not None
                if text:
                    paras.append((text, int(attr(pr, "lvl", "0")) if pr is not None else 0, mark, numbered))
            if not paras:
                continue
            if kind in ("title", "ctrTitle") and not titled:
                titled = True
                yield {"page": page, "type": "heading", "text": " ".join(p[0] for p in paras), "level": 1}
            elif any(p[2] for p in paras):
                yield {"page": page, "type": "list", "items": items([(t, v, "") for t, v, _, _ in paras]), "ordered": all(p[3] for p in paras)}
            else:
                yield from ({"page": page, "type": "paragraph", "text": p[0]} for p in paras)
        for t in below(root, "tbl"):
            tables = [[cell("".join(x.text or "" for x in below(c, "t")), i == 0) for c in kids(r, "tc")] for i, r in enumerate(kids(t, "tr"))]
            if tables:
                yield {"page": page, "type": "table", "rows": tables}
        for target in z.relations(name).values():
            if "notesSlide" in target and (notes := z.xml(target)) is not None:
                for shape in below(notes, "sp"):
                    place = first(first(shape, "nvPr"), "ph")
                    text = " ".join(t.text or "" for t in below(shape, "t")).strip()
                    if place is not None and attr(place, "type") == "body" and text:
                        yield {"page": page, "type": "blockquote", "text": text}


def epub(content: bytes) -> Iterator[dict]:
    """Each chapter of the spine a page, read as a web page. Files under rights management are refused."""
    z = Archive(content)
    if "META-INF/rights.xml" in z.names:
        raise ValueError("the book is under rights management")
    box = first(z.xml("META-INF/container.xml"), "rootfile")
    if box is None:
        raise ValueError("the book has no package")
    package = attr(box, "full-path")
    root, folder = z.xml(package), posixpath.dirname(package)
    manifest = {attr(i, "id"): posixpath.normpath(posixpath.join(folder, attr(i, "href"))) for i in below(first(root, "manifest"), "item")}
    chapters = [manifest[attr(r, "idref")] for r in below(first(root, "spine"), "itemref") if attr(r, "idref") in manifest]
    for page, name in enumerate((c for c in chapters if c in z.names), 1):
        yield from ({"page": page} | e for e in html.elements_of(z.text(name), "standard"))


def epub_metadata(content: bytes) -> dict:
    """Dublin Core fields, the first of each; creators and subjects as lists."""
    z = Archive(content)
    root = z.xml(attr(first(z.xml("META-INF/container.xml"), "rootfile"), "full-path"))
    of = lambda n: [x.text.strip() for x in below(first(root, "metadata"), n) if x.text and x.text.strip()]
    one = lambda n: (of(n) or [""])[0]
    return {k: one(k) for k in ("title", "language", "publisher", "date", "identifier", "description", "rights")} | {"creators": of("creator"), "subjects": of("subject")}


def core_metadata(content: bytes) -> dict:
    """Title, author and the like of an office file's core properties."""
    root = Archive(content).xml("docProps/core.xml")
    get = lambda n: x.text or "" if root is not None and (x := first(root, n)) is not None else ""
    return {"title": get("title"), "author": get("creator"), "subject": get("subject"), "keywords": get("keywords")}


def mismatched(content: bytes) -> Iterable[dict]:
    raise ValueError("the content is of another format than the extension says")


READERS: dict[str, Callable[[bytes], Iterable[dict]]] = {
    "mismatch": mismatched,
    "docx": docx, "odt": odt, "xlsx": xlsx, "pptx": pptx, "epub": epub, "html": lambda c: html.elements_of(c.decode("utf-8", "replace")),
}


def _rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for b in batches:
        for doc, form, content in zip(b["doc_id"], b["format"], b["content"], strict=True):
            if len(rows) >= 20_000:
                yield pd.DataFrame(rows, columns=["doc_id", *FIELDS])
                rows = []
            try:
                found = [{"page": 1} | e for e in READERS[form](bytes(content))]
            except (ValueError, KeyError, zipfile.BadZipFile, ET.ParseError) as why:
                found = [{"page": 1, "type": "warning", "text": f"{form}: {why}"}]
            rows += [(doc, *(({"pos": pos} | e).get(f) for f in FIELDS)) for pos, e in enumerate(found)]
    if rows:
        yield pd.DataFrame(rows, columns=["doc_id", *FIELDS])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path: doc_id (hash of the path), path, format and content. The format is ``mismatch`` where name and content disagree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = F.when(checked(F.col("path"), F.col("content")), by_name(F.col("path"))).otherwise("mismatch")
    return files.select(F.xxhash64("path").alias("doc_id"), "path", known.alias("format"), "content")


def file_elements(files: DataFrame) -> DataFrame:
    """Elements of files (doc_id, format, content); a file that can't be read gives one element of type warning."""
    return files.where(F.col("format").isin(*READERS)).select("doc_id", "format", "content").mapInPandas(_rows, ELEMENTS)


def select_pages(elements: DataFrame, pages: list[int]) -> DataFrame:
    """Elements of the listed pages, counted from 1; the list's order and repeats don't matter."""
    if any(p < 1 for p in pages):
        raise ValueError(f"pages count from 1: {pages}")
    return elements.where(F.col("page").isin(*sorted(set(pages))))

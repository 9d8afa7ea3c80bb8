"""Documents to chunks for retrieval: sections carried along, text blocks split to size, small chunks joined.

The steps depend on the order of elements in a document, so each document is one row with its elements in an array, and
Arrow batches of documents are folded one document at a time; documents never meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.config import SizeConfig
from folioflow.functions.sentences import byte_ends, split_to_size
from folioflow.schemas import CHUNKS, FIELDS
from folioflow.shared import arrow_schema, record_batch, slices

SPACES = re.compile("[\t\n\x0b\x0c\r \u0085   -     　]+")
#: The words that begin chapters, and how much of what follows belongs to the heading.
CHAPTER = re.compile(
    r"(?i)^[\s\\._|*]{0,4}(?:(?P<kind>CHAPTER|PART|BOOK|SECTION)\s+(?:\d{1,3}|[IVXLCDM]{1,7}|ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN|ELEVEN|TWELVE|THIRTEEN"
    r"|FOURTEEN|FIFTEEN|SIXTEEN|SEVENTEEN|EIGHTEEN|NINETEEN|TWENTY|FIRST|SECOND|THIRD|FOURTH|FIFTH)|APPENDIX\s+(?:[A-Z]|\d{1,3}|[IVXLCDM]{1,7}))(?:\b|[:.\s])"
)
TITLE_BYTES, TITLE_WORDS = 90, 12


#: Characters that Python takes for white space and we don't.
SEPARATORS = re.compile("[\x1c-\x1f]")


def count_words(text: str) -> int:
    return sum(1 for w in SPACES.split(text) if w) if SEPARATORS.search(text) else len(text.split())


def chapter_heading(text: str) -> tuple[str, str, int] | None:
    """Heading, rest and level of a paragraph that begins with a chapter mark."""
    m = CHAPTER.match(text)
    if not m:
        return None
    line = text[m.end() :]
    end = len(line)
    if (k := line.find("\n")) >= 0:
        end = k
    if s := re.search(r"[.!?](?=\s|\Z)", line[:end].lstrip(" .:")):
        end = min(end, s.end() + len(line[:end]) - len(line[:end].lstrip(" .:")))
    words = [w.end() for w in re.finditer(r"\S+", line[:end])]
    if len(words) > TITLE_WORDS:
        end = words[TITLE_WORDS - 1]
    while len((text[: m.end()] + line[:end]).encode()) > TITLE_BYTES and " " in line[:end]:
        end = line[:end].rstrip().rfind(" ")
        if end <= 0:
            end = 0
            break
    at = m.end() + end
    return text[:at].strip(" |*_\\\n\t"), text[at:].strip(), 1 if (m["kind"] or "").upper() in ("PART", "BOOK") else 2


def next_path(path: list[str], current: int, title: str, level: int) -> list[str]:
    """The section path under a new heading. A heading at or above the current level closes paths down to its level."""
    path = list(path)
    if level <= current:
        path = path[: level - 1] if len(path) >= level else path
    return [*path, title.strip()]


def level_of(e: dict) -> int:
    """A heading's level; 1 where it has none. Nested numbers may arrive as floats, and missing ones as NaN."""
    level = e["level"]
    return int(level) if level is not None and level == level and level >= 1 else 1


def list_text(items: list[dict], ordered: bool) -> str:
    """Two spaces a level; numbers count a level's items and start again under a new parent."""
    counts: dict[int, int] = {}
    out = []
    for it in items:
        level = int(it["level"] or 0)
        counts = {k: v for k, v in counts.items() if k <= level}
        counts[level] = counts.get(level, 0) + 1
        out.append("  " * level + (f"{counts[level]}. " if ordered else "- ") + it["text"])
    return "\n".join(out)


def table_text(rows: list[list[dict]]) -> str:
    cell = lambda c: (c["text"] or "").replace("\n", " ")
    lines = ["| " + " | ".join(cell(c) for c in r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * len(rows[0]), *lines[1:]])


class Chunker:
    """Folds the elements of one document into chunks."""

    def __init__(self, config: SizeConfig, detect_headings: bool = True):
        self.config, self.detect = config, detect_headings

    def chunk(self, elements: list[dict]) -> list[dict]:
        self.out, self.path, self.level, self.title, self.block, self.block_path = [], [], 0, "", "", []
        promote = self.detect and not any(e["type"] == "heading" for e in elements)
        page = None
        for e in elements:
            if page is not None and e["page"] != page:
                self.flush(page)
            page = e["page"]
            self.element(e, page, promote)
        if page is not None:
            self.flush(page)
        out = self.joined(self.out) if self.config.merge_small else self.out
        for i, c in enumerate(out):
            c |= {"chunk_index": i, "id": f"chunk-{i}", "total_chunks": len(out)}
        return out

    def element(self, e: dict, page: int, promote: bool) -> None:
        text = (e["text"] or "").strip()
        if e["type"] in ("paragraph", "code", "blockquote"):
            if promote and (found := chapter_heading(text)):
                self.flush(page)
                self.heading(found[0], found[2], page)
                text = found[1]
            if text:
                self.block = f"{self.block}\n\n{text}" if self.block else text
                self.block_path = list(self.path)
            return
        self.flush(page)
        if e["type"] == "heading" and text:
            self.heading(text, level_of(e), page)
        elif e["type"] == "list" and e["items"] is not None and len(e["items"]):
            self.emit(list_text(e["items"], bool(e["ordered"])), page, "list", "list", has_list=True)
        elif e["type"] == "table" and e["rows"] is not None and len(e["rows"]):
            self.emit(table_text(e["rows"]), page, "paragraph", "table", has_table=True)
        elif e["type"] == "image" and e["alt_text"]:
            self.emit(f"[Image: {e['alt_text']}]", page, "paragraph", "image", has_image=True)

    def heading(self, text: str, level: int, page: int) -> None:
        self.path = next_path(self.path, self.level, text, level)
        self.level, self.title = level, text
        self.emit(text, page, "section", "heading", level=level)

    def flush(self, page: int) -> None:
        if not self.block:
            return
        text, self.block = self.block, ""
        most = self.config.most
        size = {"words": count_words, "tokens": lambda t: len(t.encode()) // 4}.get(most.unit, lambda t: len(t.encode()))(text)
        limit = most.value if most.unit in ("words", "tokens", "characters") else most.in_bytes
        for piece in split_to_size(text, self.config) if size > limit else [text]:
            self.emit(piece.strip(), page, "paragraph", "paragraph", path=self.block_path)

    def emit(self, text: str, page: int, kind: str, element: str, path: list[str] | None = None, level: int | None = None, **flags: bool) -> None:
        path = list(self.path if path is None else path)
        self.out.append(
            {
                "text": text, "section_path": path, "section_title": path[-1] if path else "", "heading_level": level or self.level, "page_start": page,
                "page_end": page, "level": kind, "element_types": [element], "has_table": False, "has_list": False, "has_image": False,
            }
            | flags
        )

    def fits(self, *texts: str) -> bool:
        most = self.config.most.in_bytes
        return most <= 0 or sum(len(t.encode()) for t in texts) + 2 * (len(texts) - 1) <= most

    @staticmethod
    def merged(first: dict, second: dict, keep: dict) -> dict:
        """Both texts in order; path, title and level are those of ``keep``."""
        types = list(dict.fromkeys([*keep["element_types"], *first["element_types"], *second["element_types"]]))
        flags = {f: first[f] or second[f] for f in ("has_table", "has_list", "has_image")}
        return keep | flags | {
            "text": f"{first['text'].strip()}\n\n{second['text'].strip()}", "element_types": types,
            "page_start": min(first["page_start"], second["page_start"]), "page_end": max(first["page_end"], second["page_end"]),
        }

    def joined(self, chunks: list[dict]) -> list[dict]:
        """Headings join what follows them; then chunks under the least size join a neighbour."""
        if len(chunks) < 2:
            return chunks
        step, waiting = [], []
        for c in chunks:
            if c["element_types"] == ["heading"]:
                waiting.append(c)
                continue
            if waiting and self.fits("\n\n".join(w["text"] for w in waiting), c["text"]):
                for w in reversed(waiting):
                    c = self.merged(w, c, c)
            else:
                step += waiting
            step.append(c)
            waiting = []
        step += waiting
        least = self.config.least.in_bytes
        if least <= 0:
            return step
        out, i = [], 0
        while i < len(step):
            c = step[i]
            i += 1
            if len(c["text"].encode()) < least:
                before = out[-1] if out else None
                after = step[i] if i < len(step) else None
                if before and before["section_path"] == c["section_path"] and self.fits(before["text"], c["text"]):
                    out[-1] = self.merged(before, c, before)
                    continue
                if after and self.fits(c["text"], after["text"]):
                    c = self.merged(c, after, after)
                    i += 1
                elif before and self.fits(before["text"], c["text"]):
                    out[-1] = self.merged(before, c, before)
                    continue
            out.append(c)
        return out


def _finished(doc: object, title: str, c: dict) -> tuple:
    n = len(c["text"].encode())
    section = c["section_title"]
    return (
        doc, c["id"], c["text"], f"[{section}]\n\n{c['text']}" if section else c["text"], title, c["section_path"], section, c["heading_level"],
        c["page_start"], c["page_end"], c["chunk_index"], c["total_chunks"], c["level"], c["element_types"], c["has_table"], c["has_list"], c["has_image"],
        n, count_words(c["text"]), n // 4,
    )


def _chunked(config: SizeConfig, detect_headings: bool):
    schema = arrow_schema(CHUNKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker(config, detect_headings)
        for docs, titles, bodies in slices(batches, "doc_id", "title", "elements"):
            rows = []
            for doc, title, elements in zip(docs, titles, bodies, strict=True):
                rows += [_finished(doc, title or "", c) for c in chunker.chunk(elements)]
            yield record_batch(rows, schema)

    return run


def chunk_elements(elements: DataFrame, config: SizeConfig = SizeConfig(), detect_headings: bool = True, titles: DataFrame | None = None) -> DataFrame:
    """Chunks of documents given as elements. ``titles`` has doc_id and title."""
    own = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("elements"))
    own = own.join(titles.select("doc_id", "title"), "doc_id", "left") if titles is not None else own.withColumn("title", F.lit(""))
    return own.select("doc_id", "title", "elements").mapInArrow(_chunked(config, detect_headings), CHUNKS)


def _chunked_texts(config: SizeConfig, detect_headings: bool):
    schema = arrow_schema(CHUNKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker(config, detect_headings)
        for docs, texts in slices(batches, "doc_id", "text"):
            rows = []
            for doc, text in zip(docs, texts, strict=True):
                elements = [{"page": 1, "type": "paragraph", "text": line} for line in (text or "").split("\n") if line]
                rows += [_finished(doc, "", c) for c in chunker.chunk(elements)]
            yield record_batch(rows, schema)

    return run


def chunk_documents(docs: DataFrame, config: SizeConfig = SizeConfig(), detect_headings: bool = True) -> DataFrame:
    """Chunks of plain documents, whose lines are paragraphs of one page. Nothing is shuffled, and texts go to the workers as they are."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_chunked_texts(config, detect_headings), CHUNKS)


def section_paths(levels: list[tuple[str, int]]) -> list[list[str]]:
    """The path at each heading, for tests and small outlines."""
    out, path, current = [], [], 0
    for title, level in levels:
        path = next_path(path, current, title, level)
        current = level
        out.append(path)
    return out


def sentence_boundaries(text: str) -> list[int]:
    """Byte offsets of sentence ends inside a text."""
    return byte_ends(text)

"""Sentence and paragraph splitting, and cutting of texts to size, for one text at a time, with Arrow UDFs over them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioflow.config import SizeConfig
from folioflow.shared import slices

#: Words whose period ends no sentence.
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof sr jr vs etc inc ltd co corp jan feb mar apr jun jul aug sep oct nov dec st rd ave blvd no vol pp pg".split()
)
#: How far the cut may move for a sentence and for a word, in bytes.
SENTENCE_BACK, WORD_BACK = 200, 100


def loose_sentences(text: str) -> list[str]:
    """Ends at . ! ? unless the next character is lower case or a single capital stands before."""
    out, start = [], 0
    for m in re.finditer("[.!?]", text):
        i = m.start()
        if text[i + 1 : i + 2].islower():
            continue
        if i and "A" <= text[i - 1] <= "Z" and (i < 2 or text[i - 2].isspace()):
            continue
        if piece := text[start : i + 1].strip():
            out.append(piece)
        start = i + 1
    if rest := text[start:].strip():
        out.append(rest)
    return out


def ends_sentence(text: str, i: int) -> bool:
    """Whether the . ! or ? at i ends a sentence: white space and a capital or quote follow, and it's no abbreviation or number."""
    if text[i] == "." and i:
        before = text[i - 1]
        if before.isupper() and (i < 2 or not text[i - 2].isalpha()):
            return False
        word = re.search(r"[^\W\d_]*\Z", text[max(0, i - 12) : i])[0]
        if word.lower() in ABBREVIATIONS:
            return False
        if before.isdigit() and text[i + 1 : i + 2].isdigit():
            return False
    if i + 1 >= len(text):
        return True
    after = text[i + 2 : i + 3]
    return text[i + 1].isspace() and (after.isupper() or after in ('"', "'")) and after != ""


def sentence_ends(text: str) -> list[int]:
    return [m.start() + 1 for m in re.finditer("[.!?]", text) if ends_sentence(text, m.start())]


def byte_ends(text: str) -> list[int]:
    """The sentence ends as byte offsets."""
    ends = sentence_ends(text)
    if text.isascii():
        return ends
    out, at, last = [], 0, 0
    for i in ends:
        at += len(text[last:i].encode())
        out.append(at)
        last = i
    return out


def strict_sentences(text: str) -> list[str]:
    cuts = [0, *sentence_ends(text), len(text)]
    return [p for a, b in zip(cuts[:-1], cuts[1:], strict=True) if (p := text[a:b].strip())]


def paragraph_list(text: str) -> list[str]:
    """Paragraphs between blank lines, their lines joined by spaces."""
    parts = re.split(r"\n[ \t]*\n", text)
    return [p for part in parts if (p := " ".join(x for line in part.split("\n") if (x := line.strip())))]


def _back(data: bytes, at: int) -> int:
    """The start of the character that ``at`` is in."""
    while at > 0 and at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _cut(data: bytes, want: int, most: int) -> int:
    ends = lambda i: data[i - 1] in b".!?" and (i >= len(data) or data[i] in b" \n")
    for i in range(want, max(0, want - SENTENCE_BACK), -1):
        if ends(i):
            return i
    for i in range(want + 1, most + 1):
        if ends(i):
            return i
    for i in range(want, max(0, want - WORD_BACK), -1):
        if i < len(data) and data[i] in b" \n":
            return i
    for i in range(want + 1, min(most + 1, len(data))):
        if data[i] in b" \n":
            return i
    return most


def split_to_size(text: str, config: SizeConfig = SizeConfig()) -> list[str]:
    """Pieces of at most the greatest size, cut at sentence ends, else between words, else between characters.

    Where what would be left is under the least size, the text is cut near its middle instead.
    """
    most, least = config.most.in_bytes, config.least.in_bytes
    data, out = text.encode(), []
    while len(data) > most > 0:
        want = len(data) // 2 if len(data) - most < least else most
        at = _back(data, _cut(data, want, most)) or most
        if piece := data[:at].decode(errors="ignore").strip():
            out.append(piece)
        rest = data[at:].decode(errors="ignore").strip().encode()
        if len(rest) >= len(data):
            break
        data = rest
    if data:
        out.append(data.decode(errors="ignore"))
    return out


def character_overlap(text: str, size: int, keep_words: bool = True) -> str:
    """The last ``size`` bytes, from the next word on."""
    data = text.encode()
    if len(data) <= size:
        return text
    tail = data[_back(data, len(data) - size) :].decode(errors="ignore")
    if keep_words:
        tail = re.sub(r"\A\S*\s*", "", tail)
    return tail.strip()


def text_udf(f: Callable[[str], object], kind: T.DataType) -> Callable[[Column], Column]:
    """``f`` over texts (null: empty) as a function of Columns. Texts become Python's, and what it returns leaves the worker, a slice at a time, not by whole batches."""
    made = to_arrow_type(kind)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for (part,) in slices([pa.record_batch([texts], ["t"])], "t"):
                yield pa.array([f(t or "") for t in part], made)

    return F.arrow_udf(run, kind)


def sentences_of(text: Column, strict: bool = True) -> Column:
    return text_udf(strict_sentences if strict else loose_sentences, T.ArrayType(T.StringType()))(text)


def pieces_of(text: Column, config: SizeConfig = SizeConfig()) -> Column:
    return text_udf(lambda t: split_to_size(t, config), T.ArrayType(T.StringType()))(text)

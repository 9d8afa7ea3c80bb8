"""Text measures and tests as Columns. Sizes are bytes throughout; everything here stays in generated code."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.config import UNIT_BYTES, Limit, MetadataConfig

#: Unicode white space, as a character class.
SPACE = r"\t\n\x0B\f\r \u0085   -     　"
TRIM = " \t\n\x0b\x0c\r\u0085 "
#: Bullets, checkbox marks, words that introduce lists, page-number shapes.
BULLETS = ("•", "●", "○", "■", "□", "▪", "▫", "-", "*", "–", "—", "·")
ORDERED = r"^(\d+[.)]|[a-z][.)]|[ivxlcdm]+[.)]|\(\d+\)|\([a-z]\))[\t\n\f\r ]"
CHECKBOX = r"^(\[[ xX✓✗]\]|☐|☑|☒)[\t\n\f\r ]"
INTRO = (
    r"(the[\t\n\f\r ]+following|here[\t\n\f\r ]+are|these[\t\n\f\r ]+(are|include)|below[\t\n\f\r ]+(are|is)|as[\t\n\f\r ]+follows)[\t\n\f\r ]*:?[\t\n\f\r ]*\z",
    r"(steps?|features?|items?|points?|reasons?|benefits?|advantages?|options?|examples?)[\t\n\f\r ]*:?[\t\n\f\r ]*\z",
    r"(include|includes|including|such[\t\n\f\r ]+as|for[\t\n\f\r ]+example|e\.g\.|i\.e\.)[\t\n\f\r ]*:?[\t\n\f\r ]*\z",
    r":[\t\n\f\r ]*\z",
)
PAGE_NUMBERS = ("#", "page #", "- # -", "# of #", "page # of #", "#/#", "p. #", "p.#", "pg #", "pg. #")
TABLE_WORDS = ("table ", "tbl ", "tbl.", "tab ", "tab.")
FIGURE_WORDS = ("figure ", "fig ", "fig.", "image ", "img ", "photo ", "diagram ", "illustration ", "chart ", "graph ", "plot ")


def size(text: Column) -> Column:
    """Bytes."""
    return F.octet_length(text).cast("long")


def words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def tokens(text: Column, per_byte: float = 0.25) -> Column:
    """Estimated tokens."""
    return F.floor(size(text) * (per_byte if per_byte > 0 else 0.25)).cast("long")


def sentences(text: Column) -> Column:
    """Sentence ends before white space or the end, plus one for an unfinished rest. Punctuation that opens a text is no end."""
    body = F.regexp_replace(text, r"\A[.!?]([ \n\t])", "x$1")
    rest = F.regexp_replace(body, r"(?s)\A.*[.!?](?:[ \n\t]|\z)", "")
    ends = F.regexp_count(body, F.lit(r"[.!?](?:[ \n\t]|\z)"))
    return F.when(text == "", F.lit(0)).otherwise(ends + rest.rlike(r"[^ \n\t]").cast("int")).cast("long")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIM))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines that aren't blank; one at least if there is text."""
    n = F.size(F.filter(F.split(text, "\n\n"), lambda p: trimmed(p) != ""))
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(n, F.lit(1))).cast("long")


def measures(text: Column) -> Column:
    return F.struct(
        size(text).alias("characters"), tokens(text).alias("tokens"), words(text).alias("words"),
        sentences(text).alias("sentences"), paragraphs(text).alias("paragraphs"),
    )


def in_unit(text: Column, unit: str) -> Column:
    return {"characters": size, "tokens": tokens, "words": words, "sentences": sentences, "paragraphs": paragraphs}[unit](text)


def converted(value: Column, unit: str, to: str) -> Column:
    """A size in another unit, by the bytes both stand for."""
    return F.floor(value * UNIT_BYTES[unit] / UNIT_BYTES[to]).cast("long")


def below(text: Column, limit: Limit) -> Column:
    return in_unit(text, limit.unit) < limit.value


def above(text: Column, limit: Limit) -> Column:
    return in_unit(text, limit.unit) > limit.value


def within(text: Column, limit: Limit) -> Column:
    """Near a soft target by a fifth, or equal to a hard one."""
    n = in_unit(text, limit.unit)
    margin = int(limit.value * 0.2)
    return n.between(limit.value - margin, limit.value + margin) if limit.soft else n == limit.value


def verdict(text: Column, least: Limit, most: Limit) -> Column:
    """What to do with a chunk of this size: ok, merge, or split."""
    return F.when(above(text, most), "split").when(below(text, least), "merge").otherwise("ok")


def list_kind(line: Column) -> Column:
    """ordered, checklist, definition, unordered or empty."""
    line = trimmed(line)
    term = trimmed(F.substring_index(line, ": ", 1))
    definition = line.contains(": ") & (term != "") & (F.octet_length(term) < 50) & ~term.contains(".")
    bullet = F.lit(False)
    for b in BULLETS:
        bullet = bullet | line.startswith(b + " ") | line.startswith(b + "\t")
    return F.when(line.rlike(ORDERED), "ordered").when(line.rlike(CHECKBOX), "checklist").when(definition, "definition").when(bullet, "unordered").otherwise("")


def list_marker(line: Column) -> Column:
    """The marker that a line starts with, or empty."""
    line = trimmed(line)
    bullet = F.lit("")
    for b in reversed(BULLETS):
        bullet = F.when(line.startswith(b + " ") | line.startswith(b + "\t"), b).otherwise(bullet)
    return F.when(line.rlike(ORDERED), F.regexp_extract(line, ORDERED, 1)).when(line.rlike(CHECKBOX), F.regexp_extract(line, CHECKBOX, 1)).otherwise(bullet)


def indent_level(line: Column) -> Column:
    """Leading spaces halved; a tab is four spaces."""
    lead = F.regexp_extract(line, r"\A([ \t]*)", 1)
    return F.floor((F.length(lead) + 3 * F.regexp_count(lead, F.lit("\t"))) / 2).cast("int")


def introduces_list(text: Column) -> Column:
    text = trimmed(text)
    out = F.lit(False)
    for p in INTRO:
        out = out | text.rlike("(?iu)" + p)
    return out


def is_caption(text: Column, kind: str) -> Column:
    """Whether a text reads like the caption of a ``table`` or ``figure``."""
    lower = F.lower(trimmed(text))
    out = F.lit(False)
    for w in TABLE_WORDS if kind == "table" else FIGURE_WORDS:
        out = out | lower.startswith(w)
    named = lower.contains("table") if kind == "table" else lower.contains("fig")
    return out | (named & text.rlike("[0-9]"))


def digits_masked(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "#")


def is_page_number(text: Column) -> Column:
    return F.lower(trimmed(digits_masked(text))).isin(*PAGE_NUMBERS)


def direction(text: Column) -> Column:
    """ltr, rtl or neutral by the majority of letters."""
    rtl = F.regexp_count(text, F.lit(r"[֐-ࣿיִ-﷿ﹰ-ﻼ]"))
    ltr = F.regexp_count(text, F.lit(r"[A-Za-zÀ-ɏͰ-֏Ḁ-῿぀-ヿ一-鿿가-힯]"))
    return F.when(rtl > ltr, "rtl").when(ltr > 0, "ltr").otherwise("neutral")


def all_caps(text: Column) -> Column:
    """Over nine tenths of at least three ASCII letters are capitals."""
    upper, letters = F.regexp_count(text, F.lit("[A-Z]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return (letters >= 3) & (upper > 0.9 * letters)


def anchor(text: Column) -> Column:
    """A heading's anchor: lower case, dashes for spaces, letters, digits and dashes only."""
    x = F.regexp_replace(F.regexp_replace(F.lower(text), " ", "-"), "[^a-z0-9-]", "")
    return F.btrim(F.regexp_replace(x, "-+", "-"), F.lit("-"))


def without_number(text: Column) -> Column:
    """A heading without its number."""
    return trimmed(F.regexp_replace(text, r"^[0-9]+(\.[0-9]+)*\.?[ \t]+", ""))


def path(sections: Column, by: str = " > ") -> Column:
    return F.array_join(sections, by)


def page_range(first: Column, last: Column) -> Column:
    one = F.concat(F.lit("p. "), first.cast("string"))
    return F.when(first == last, one).otherwise(F.concat(F.lit("pp. "), first.cast("string"), F.lit("-"), last.cast("string")))


def reading_minutes(n_words: Column, per_minute: int = 200) -> Column:
    return n_words / (per_minute if per_minute > 0 else 200)


def reading_time(n_words: Column, per_minute: int = 200) -> Column:
    m = reading_minutes(n_words, per_minute)
    return F.when(m < 1, "< 1 min read").otherwise(F.concat(F.bround(m).cast("int").cast("string"), F.lit(" min read")))


def context(text: Column, title: Column, sections: Column, section: Column, first: Column, last: Column, config: MetadataConfig = MetadataConfig()) -> Column:
    """The text under a line that says where it is from, in one of the formats bracket, markdown, breadcrumb, xml or none."""
    if config.format == "none":
        return text
    where = F.when(F.lit(config.path) & (F.size(sections) > 0), path(sections)).when(F.coalesce(section, F.lit("")) != "", section)
    parts = F.array_compact(
        F.array(
            F.when(F.lit(config.title) & (F.coalesce(title, F.lit("")) != ""), title), where, F.when(F.lit(config.pages) & (first > 0), page_range(first, last))
        )
    )
    line = F.array_join(parts, " | ")
    form = {"bracket": ("[", "]\n\n"), "markdown": ("# ", "\n\n"), "breadcrumb": ("", "\n---\n"), "xml": ("<context>", "</context>\n\n")}[config.format]
    return F.when(F.size(parts) == 0, text).otherwise(F.concat(F.lit(form[0]), line, F.lit(form[1]), text))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_markdown(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def roman_value(text: Column) -> Column:
    """Value of a Roman number; a smaller digit before a larger one counts against."""
    v = F.transform(F.split(F.upper(text), ""), lambda c: F.create_map(*[F.lit(x) for p in dict(I=1, V=5, X=10, L=50, C=100, D=500, M=1000).items() for x in p])[c])
    v = F.filter(v, lambda x: x.isNotNull())
    return F.aggregate(
        F.transform(v, lambda x, i: F.when(F.coalesce(F.get(v, i + 1), F.lit(0)) > x, -x).otherwise(x)), F.lit(0), lambda a, x: a + x
    )


def column_index(letters: Column) -> Column:
    """0-based number of a spreadsheet column's letters."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64)) - 1


def column_letters(index: Column) -> Column:
    """Letters of a 0-based column number under 18,278 (three letters)."""
    a, b, c = F.floor((index - 702) / 676), F.floor((index - 26) / 26), index % 26
    letter = lambda x: F.chr(65 + x)
    return (
        F.when(index < 26, letter(c))
        .when(index < 702, F.concat(letter(b), letter(c)))
        .otherwise(F.concat(letter(a), letter(F.floor((index - 702) / 26) % 26), letter(c)))
    )


# Lines that introduce a list, in the wider vocabulary.
WIDE_INTRO = [
    r"\b(the\s+following|here\s+are|these\s+(are|include)|below\s+(are|is)|as\s+follows)\s*:\s*$",
    r"\b(steps?|features?|items?|points?|reasons?|benefits?|advantages?|disadvantages?|options?|examples?|requirements?|prerequisites?|instructions?|"
    r"guidelines?|rules?|conditions?|criteria|objectives?|goals?|tasks?|actions?|methods?|approaches?|techniques?|strategies?|tips?|recommendations?|"
    r"suggestions?|notes?|warnings?|cautions?|considerations?)\s*:?\s*$",
    r"\b(include|includes|including|consist\s+of|consists\s+of|comprised\s+of|such\s+as|for\s+example|for\s+instance|e\.g\.|i\.e\.)\s*:?\s*$",
    r"\b(you\s+(can|should|must|need\s+to|will)|we\s+(can|should|must|will)|to\s+do\s+this)\s*:?\s*$",
    r"\b\w+\s*:\s*$",
]
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def introduces_list_widely(text: Column) -> Column:
    """Whether a text, trimmed, ends like the introduction of a list."""
    text, out = trimmed(text), F.lit(False)
    for p in WIDE_INTRO:
        out = out | text.rlike("(?i)" + p)
    return (text != "") & out


def char_direction(char: Column) -> Column:
    """rtl, ltr or neutral for one character: digits, punctuation, spaces and symbols are neutral."""
    neutral = char.rlike(r"^[\p{Nd}\p{P}\p{Z}\p{S}\t\n\x0B\f\r]$")
    rtl = char.rlike(r"^[\u0590-\u05FF\u0600-\u07FF\u08A0-\u08FF\uFB1D-\uFDFF\uFE70-\uFEFF]$")
    return F.when(neutral, "neutral").when(rtl, "rtl").otherwise("ltr")


def contains_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def upper_roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999; other numbers in digits."""
    out, rest = F.lit(""), n
    for value, symbol in ROMAN:
        out = F.concat(out, F.repeat(F.lit(symbol), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when((n < 1) | (n > 3999), n.cast("string")).otherwise(out)


def lower_letters(n: Column) -> Column:
    """1 is a, 26 z, 27 aa; a for numbers under 1."""
    return F.when(n < 1, "a").otherwise(F.lower(column_letters(n - 1)))


def decoded_utf16(data: Column, big_endian: bool = True) -> Column:
    return F.decode(data, "UTF-16BE" if big_endian else "UTF-16LE")


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


def composed(text: Column) -> Column:
    """Unicode normal form C. Spark has no function for it; texts in Latin-1 are in that form already and don't leave the JVM."""
    return F.when(text.rlike(r"^[\x00-\xFF]*$"), text).otherwise(_composed(text))


def extension(file_format: Column) -> Column:
    """The usual file extension of a format, or empty."""
    known = ("pdf", "docx", "odt", "xlsx", "pptx", "html", "epub")
    return F.when(F.lower(file_format).isin(*known), F.concat(F.lit("."), F.lower(file_format))).otherwise("")


def warnings_text(warnings: Column) -> Column:
    """The messages of warnings (code, message), by semicolons."""
    return F.array_join(F.transform(warnings, lambda w: w["message"]), "; ")


def appended_once(values: Column, value: Column) -> Column:
    """The array with the value at its end, unless it is in it."""
    return F.when(F.array_contains(values, value), values).otherwise(F.array_append(values, value))


def value_text(value: Column, kind: str) -> Column:
    """A value as a CSV field: floats with six decimals, booleans in lower case, arrays in brackets."""
    if kind in ("double", "float"):
        return F.format_string("%.6f", value.cast("double"))
    if kind.startswith("array"):
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: value_text(x, kind[6:-1])), ","), F.lit("]"))
    return F.to_json(value) if kind.startswith(("struct", "map")) else value.cast("string")

"""Renderings of tables that are arrays of rows of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import escape_html, trimmed


def _flat(cell: Column) -> Column:
    return F.replace(F.coalesce(cell, F.lit("")), F.lit("\n"), F.lit(" "))


def markdown(rows: Column) -> Column:
    """Row 0 is the header; line feeds become spaces."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, _flat), " | "), F.lit(" |\n"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda _: F.lit(" --- |")), ""), F.lit("\n"))
    lines = F.transform(rows, lambda r, i: F.when(i == 0, F.concat(line(r), rule)).otherwise(line(r)))
    return F.when(F.size(rows) == 0, F.lit("")).otherwise(F.array_join(lines, ""))


def csv(rows: Column) -> Column:
    """Fields with a comma, quote or line break are quoted."""
    field = lambda c: F.when(
        c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(c)
    return F.array_join(F.transform(rows, lambda r: F.concat(F.array_join(F.transform(r, lambda c: field(F.coalesce(c, F.lit("")))), ","), F.lit("\n"))), "")


def plain(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "\t")), "\n")


def html(rows: Column) -> Column:
    cell = lambda c, i: F.when(i == 0, F.concat(F.lit("    <th>"), escape_html(c), F.lit("</th>\n"))).otherwise(
        F.concat(F.lit("    <td>"), escape_html(c), F.lit("</td>\n"))
    )
    row = lambda r, i: F.concat(F.lit("  <tr>\n"), F.array_join(F.transform(r, lambda c: cell(F.coalesce(c, F.lit("")), i)), ""), F.lit("  </tr>\n"))
    return F.concat(F.lit("<table>\n"), F.array_join(F.transform(rows, row), ""), F.lit("</table>"))


def headers(rows: Column) -> Column:
    return F.filter(F.transform(F.get(rows, F.lit(0)), trimmed), lambda c: c != "")


def summary(rows: Column) -> Column:
    """Rows, columns, and the first five headers."""
    h = headers(rows)
    head = F.concat(
        F.lit("Table with "), F.size(rows).cast("string"), F.lit(" rows and "), F.size(F.get(rows, F.lit(0))).cast("string"), F.lit(" columns")
    )
    first = F.array_join(F.slice(h, 1, 5), ", ")
    many = F.concat(head, F.lit(". Columns include: "), first, F.lit(", ..."))
    return F.when(F.size(h) > 5, many).when(F.size(h) > 0, F.concat(head, F.lit(". Columns: "), first)).otherwise(head)


def cell(rows: Column, row: int, column: int) -> Column:
    return F.get(F.get(rows, F.lit(row)), F.lit(column))


def split(rows: Column, most: int = 50) -> Column:
    """Parts of ``most`` body rows, each under the header row."""
    body = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    parts = F.greatest(F.ceil(F.size(body) / most), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.concat(F.slice(rows, 1, 1), F.slice(body, i * most + 1, F.lit(most))))


def list_markdown(items: Column, ordered: Column) -> Column:
    """Items (text, level) as a list, two spaces a level."""
    mark = lambda i: F.when(ordered, F.concat((i + 1).cast("string"), F.lit(". "))).otherwise(F.lit("- "))
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.repeat(F.lit("  "), x["level"]), mark(i), x["text"])), "\n")


def six_decimals(x: Column) -> Column:
    """A 32-bit float with six decimals, its exact value rounded half to even, as C prints it.

    Java rounds its shortest decimal text instead. A float has 24 bits and 15625 has 14, so a million times it is exact in 53.
    """
    d = x.cast("double")
    n = F.abs(F.rint(d * 1e6))
    whole = F.floor(n / 1e6)
    sign = F.when((d < 0) | (d.cast("string") == "-0.0"), "-").otherwise("")
    short = F.concat(sign, whole.cast("string"), F.lit("."), F.lpad((n - whole * 1e6).cast("long").cast("string"), 6, "0"))
    # From 2^23 on a float has no fraction; under 2^63 its digits are a long's.
    large = F.concat(sign, F.abs(d).cast("long").cast("string"), F.lit(".000000"))
    named = F.when(F.isnan(d), "nan").when(F.abs(d) == float("inf"), F.concat(sign, F.lit("inf")))
    return F.when(d.isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(named, F.when(F.abs(d) < 2.0**23, short).when(F.abs(d) < 2.0**62, large).otherwise(F.format_string("%.6f", d)))
    )


def embedding_text(v: Column) -> Column:
    """[a,b,...] with six decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, six_decimals), ","), F.lit("]"))


def with_cell(rows: Column, row: int, column: int, value: Column) -> Column:
    """The table with another value in a cell; unchanged if there is no such cell."""
    changed = lambda r: F.transform(r, lambda c, j: F.when(j == column, value).otherwise(c))
    return F.transform(rows, lambda r, i: F.when(i == row, changed(r)).otherwise(r))

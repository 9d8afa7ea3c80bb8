"""Formats of files, by name and by content."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats and their extensions.
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "odt": "odt", "xlsx": "xlsx", "pptx": "pptx", "html": "html", "htm": "html", "epub": "epub"}
ZIP_TYPES = {"application/vnd.oasis.opendocument.text": "odt", "application/epub+zip": "epub"}
ZIP_PARTS = (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"))


def by_name(path: Column) -> Column:
    """Format by the extension; unknown if there is none of ours."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit("unknown")
    for e, name in EXTENSIONS.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def by_magic(content: Column) -> Column:
    """Format by the first bytes: PDF or HTML; archives stay unknown."""
    start = F.lower(F.btrim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    page = start.startswith("<!doctype html") | start.startswith("<html") | start.startswith("<head") | start.startswith("<body")
    return F.when(start.startswith("%pdf"), "pdf").when(page, "html").otherwise("unknown")


def format_of_zip(content: bytes) -> str:
    """Format of an archive: its mimetype member, then an EPUB container, then the folders of office files."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if "mimetype" in names:
                kind = ZIP_TYPES.get(z.read("mimetype").decode("ascii", "ignore").strip())
                if kind:
                    return kind
            if "META-INF/container.xml" in names:
                return "epub"
            return next((f for p, f in ZIP_PARTS if any(n.startswith(p) for n in names)), "unknown")
    except (zipfile.BadZipFile, KeyError, RuntimeError):
        return "unknown"


@F.pandas_udf(T.StringType())
def _zip(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: format_of_zip(bytes(c)) if c is not None and bytes(c[:2]) == b"PK" else "unknown")


def by_content(content: Column) -> Column:
    magic = by_magic(content)
    return F.when(magic != "unknown", magic).otherwise(_zip(content))


def checked(path: Column, content: Column) -> Column:
    """Whether name and content agree; content that isn't known passes."""
    found = by_content(content)
    return (found == "unknown") | (found == by_name(path))

"""Files as tables: discovery, types, and text extraction by type."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.html import read_page

# The file types by extension.
TYPES = {"pdf": "pdf", "txt": "txt", "text": "txt", "md": "md", "markdown": "md", "html": "html", "htm": "html", "docx": "docx", "xlsx": "xlsx", "epub": "epub"}
RESULT = "struct<text:string,method:string,success:boolean,error:string,encoding:string>"


def file_type(path: str | Column) -> Column:
    """The type of a path by its extension; unknown for others."""
    ext = F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"\.([^./\\]+)$", 1))
    out = F.lit("unknown")
    for e, t in TYPES.items():
        out = F.when(ext == e, t).otherwise(out)
    return out


def discover(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content, file_type) of the files of known types under a folder, by path.

    Symbolic links of a local folder are left out, as are files below a linked folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    local = folder.removeprefix("file://")
    if local.startswith("/") and os.path.isdir(local):
        links = [os.path.join(d, x) for d, folders, names in os.walk(local) for x in (*folders, *names) if os.path.islink(os.path.join(d, x))]
        for x in links:
            bare = F.regexp_replace("path", "^file:/*", "/")
            files = files.where((bare != x) & ~bare.startswith(x + "/"))
    return files.withColumn("file_type", file_type("path")).where("file_type <> 'unknown'").orderBy("path")


def should_index(path: Column, size: Column, include: list[str], exclude: list[str], most: int = 100 << 20) -> Column:
    """The reason why a file is not taken (excluded, too large, not included), or ok. Excludes match the path, includes the name."""
    glob = lambda p: "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) + "$"
    name = F.regexp_replace(path, "^.*/", "")
    out = F.lit(False)
    for p in exclude:
        out = out | path.rlike(glob(p))
    taken = F.lit(not include)
    for p in include:
        taken = taken | name.rlike(glob(p))
    return F.when(out, "excluded").when(size > most, "too_large").when(~taken, "not_included").otherwise("ok")


def _plain(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _html(data: bytes) -> str:
    return read_page(_plain(data))["text"]


def _docx(data: bytes) -> str:
    """Paragraphs, and table rows with cells joined by bars."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    words = lambda x: "".join(t.text or "" for t in x.iter(f"{w}t"))
    out = []
    for block in body:
        if block.tag == f"{w}p":
            out.append(words(block))
        elif block.tag == f"{w}tbl":
            out += [" | ".join(words(c) for c in row.iter(f"{w}tc")) for row in block.iter(f"{w}tr")]
    return "\n".join(x for x in out if x.strip())


def _xlsx(data: bytes) -> str:
    """Each sheet as a heading and its rows, cells joined by bars."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{m}si")]
    # sheets are named in the workbook, and found through its relations
    related = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    targets = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet"))
    names = [s.get("name") for s in book]
    sheets = [f"xl/{targets.get(s.get(related), f'worksheets/sheet{i}.xml')}" for i, s in enumerate(book, 1)]
    out = []
    for name, part in zip(names, sheets):
        out.append(f"## {name}")
        for row in ElementTree.fromstring(z.read(part)).iter(f"{m}row"):
            cells = []
            for c in row.iter(f"{m}c"):
                v = c.find(f"{m}v")
                inline = "".join(t.text or "" for t in c.iter(f"{m}t"))
                cells.append(shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else inline)
            out.append(" | ".join(x or "" for x in cells))
    return "\n".join(out)


def epub_parts(data: bytes) -> dict:
    """title, authors and chapter names of an EPUB, chapters in the order of its spine; by name where it has none."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    pages = sorted(x for x in names if x.lower().endswith((".xhtml", ".html", ".htm")))
    package = next((x for x in names if x.endswith(".opf")), None)
    if package is None:
        return {"title": None, "authors": [], "chapters": pages}
    root = ElementTree.fromstring(z.read(package))
    folder = package.rpartition("/")[0]
    bare = lambda e: e.tag.rpartition("}")[2]
    items = {e.get("id"): "/".join(x for x in (folder, e.get("href")) if x) for e in root.iter() if bare(e) == "item"}
    spine = [items.get(e.get("idref")) for e in root.iter() if bare(e) == "itemref"]
    text = lambda kind: [(e.text or "").strip() for e in root.iter() if bare(e) == kind and (e.text or "").strip()]
    return {"title": next(iter(text("title")), None), "authors": text("creator"), "chapters": [x for x in spine if x in names] or pages}


def _epub(data: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(data))
    return "\n\n".join(t for t in (_html(z.read(x)) for x in epub_parts(data)["chapters"]) if t)


#: Extractors by file type: bytes to text. Others (PDF) are passed to extract_files().
EXTRACTORS: dict[str, Callable[[bytes], str]] = {"txt": _plain, "md": _plain, "html": _html, "docx": _docx, "xlsx": _xlsx, "epub": _epub}


def encoding(data: bytes) -> str:
    """utf-8, or latin-1 for bytes that are none."""
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "latin-1"


def extract(kind: str | None, data: bytes | None, extractors: dict[str, Callable[[bytes], str]] | None = None) -> dict:
    """The text of a file; a file that cannot be read gives a row with its error and not an exception."""
    known = EXTRACTORS | (extractors or {})
    if data is None or kind not in known:
        return {"text": None, "method": kind, "success": False, "error": "no content" if data is None else f"no extractor for {kind}", "encoding": None}
    try:
        return {"text": known[kind](data), "method": kind, "success": True, "error": None, "encoding": encoding(data) if kind in ("txt", "md", "html") else None}
    except Exception as e:  # noqa: BLE001 - any broken file
        return {"text": None, "method": kind, "success": False, "error": f"{type(e).__name__}: {e}"[:200], "encoding": None}


def extract_files(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """files of discover() with text, method, success, error and encoding instead of their content.

    extractors, by file type, are added to those there are, or take their place; they go to the executors with the plan.
    """

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, data in batches:
            yield pd.DataFrame([extract(k, d, extractors) for k, d in zip(kinds, data)], columns=["text", "method", "success", "error", "encoding"])

    return files.withColumn("__r", run("file_type", "content")).select(*[c for c in files.columns if c != "content"], "__r.*")


def failure(text: Column, error: Column, least: int = 50, html: Column | None = None, images: Column | None = None) -> Column:
    """Why an extraction gave nothing: encrypted, malformed, needs_script, image_only, empty, too_short, or unknown for an error that says nothing; null if it did.

    html is the page a text was taken from, images how many a file has; either may be missing.
    """
    from docweave.functions.html import needs_script

    e = F.lower(F.coalesce(error, F.lit("")))
    blank = F.coalesce(F.btrim(text), F.lit("")) == ""
    out = F.when(e.contains("encrypt") | e.contains("password"), "encrypted").when(e.rlike("malform|corrupt|parse|bad zip|badzip|decode|invalid|syntax"), "malformed").when(e != "", "unknown")
    short = F.coalesce(F.length(text) < least, F.lit(True))
    if html is not None:
        out = out.when(short & F.coalesce(needs_script(html), F.lit(False)), "needs_script")
    if images is not None:
        out = out.when(blank & (images > 0), "image_only")
    return out.when(blank, "empty").when(F.length(text) < least, "too_short")

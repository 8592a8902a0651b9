"""Readers of document files: type by extension, tolerant decoding, tables as text; what can't be read is a row with an error."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAIN, SHEETS = ("txt", "md", "log", "json", "html"), ("csv", "tsv", "xlsx")
MAX_ROWS = 5_000
CUT = "[truncated: more rows than the limit]"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_LINK = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
MISSING = "[missing: the file has no such sheet]"


def decode(data: bytes) -> str:
    """UTF-8, else Windows-1252, else UTF-8 with replacements."""
    for encoding in ("utf-8", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="replace")


def piped(title: str, rows: list[list[str]]) -> str:
    """A titled table with pipes; short rows are filled up."""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return f"## {title}\n\n" + "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])


def _workbook(data: bytes) -> Iterator[tuple[str, Iterator[list[str]] | None]]:
    """Sheets of a spreadsheet file with their rows, in the workbook's order; the relationships tell where each is kept. None
    for rows: it is named but not there."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        links = {}
        if "xl/_rels/workbook.xml.rels" in names:
            links = {x.get("Id"): x.get("Target") or "" for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(_LINK)}
        for n, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"), 1):
            title, target = sheet.get("name"), links.get(sheet.get(_ID), f"worksheets/sheet{n}.xml")
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            if part not in names:
                yield title, None
                continue
            rows = []
            for row in ElementTree.fromstring(z.read(part)).iter(f"{_MAIN}row"):
                cells: list[str] = []
                for c in row.iter(f"{_MAIN}c"):
                    letters = re.match("[A-Z]*", c.get("r") or "")[0]
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
                    raw = c.findtext(f"{_MAIN}v") or "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    cells += [""] * (at - len(cells))
                    cells.append(shared[int(raw)] if c.get("t") == "s" and raw else raw)
                rows.append(cells)
            yield title, iter(rows)


def tables(data: bytes, kind: str, most: int | None = -1) -> str:
    """Every sheet of a file as a table: blank rows go, pipes are escaped, `most` rows over all sheets (-1: MAX_ROWS, None: all)."""
    most = MAX_ROWS if most == -1 else most
    csv.field_size_limit(max(len(data), 1 << 17))  # a cell may be as long as its file
    if kind == "xlsx":
        sheets = _workbook(data)
    else:
        sheets = iter([("table", csv.reader(io.StringIO(decode(data)), delimiter="\t" if kind == "tsv" else ","))])
    parts, seen = [], 0
    for title, rows in sheets:
        if rows is None:
            parts.append(f"## {title}\n\n{MISSING}")
            continue
        kept = []
        for row in rows:
            cells = [c.strip().replace("|", "\\|") for c in row]
            if not any(cells):
                continue
            if most is not None and seen >= most:
                break
            kept.append(cells)
            seen += 1
        else:
            rows = None
        if kept:
            parts.append(piped(title, kept))
        if rows is not None:
            parts.append(CUT)
    if not parts:
        raise ValueError("no cells")
    return "\n\n".join(parts)


def _texts(most: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for kind, data in zip(batch["kind"], batch["content"]):
                try:
                    if kind not in PLAIN + SHEETS:
                        raise ValueError(f"{kind}: one of {', '.join(PLAIN + SHEETS)} is needed")
                    texts.append(tables(bytes(data), kind, most) if kind in SHEETS else decode(bytes(data)))
                    errors.append(None)
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError, csv.Error) as e:
                    texts.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({"path": batch["path"], "kind": batch["kind"], "text": texts, "error": errors})

    return run


def kind_of(path):
    """What follows the last dot of the name, in small letters; txt without one."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("txt")


def documents(spark: SparkSession, path: str, most: int | None = -1) -> DataFrame:
    """(path, kind, text, error) of every file below `path`; files are read whole in tasks. `most` rows of a spreadsheet (-1: MAX_ROWS, None: all)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", kind_of(F.col("path")).alias("kind"), "content").mapInPandas(_texts(most), "path string, kind string, text string, error string")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a text file, one a line, without blank ones and comments."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(line.alias("term"))


def append_lines(rows: DataFrame, path: str) -> None:
    """One JSON line a row, appended."""
    rows.write.mode("append").json(path)


def newest_lines(spark: SparkSession, path: str, schema: str, order: str, n: int = 50) -> DataFrame:
    """The n newest rows of such a log, newest first."""
    return spark.read.schema(schema).json(path).orderBy(F.desc(order)).limit(n)

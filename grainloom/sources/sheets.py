"""Spreadsheets (S06-S08): .xlsx files are ZIP archives of XML, which executors read without further libraries."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def cells(content: bytes, sheet: int = 1) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number from 1, column number: text) of a sheet, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.parse(f).getroot().iter(f"{_NS}si")]
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag == f"{_NS}row":
                    found = {}
                    for at, c in enumerate(row.iter(f"{_NS}c")):
                        kind, v = c.get("t"), c.find(f"{_NS}v")
                        text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if kind == "inlineStr" else v.text if v is not None else None
                        if text is not None:
                            found[_column(c.get("r")) if c.get("r") else at] = shared[int(text)] if kind == "s" else text
                    yield int(row.get("r")), found
                    row.clear()


def read_xlsx(spark: SparkSession, path: str, columns: int, sheet: int = 1) -> DataFrame:
    """row (its number) and c0, c1, ... (text; null where a cell is empty) of the files at path; one task a file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for content in pdf["content"]:
                rows = [(n, *(found.get(k) for k in range(columns))) for n, found in cells(content, sheet)]
                yield pd.DataFrame(rows, columns=["row", *(f"c{k}" for k in range(columns))])

    schema = "row bigint, " + ", ".join(f"c{k} string" for k in range(columns))
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def sheet_bytes(rows: list[list[object]]) -> bytes:
    """A workbook of one sheet with these cells (None is an empty one): for small tables and tests."""

    def cell(v: object) -> str:
        return "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    body = "".join(f'<row r="{i + 1}">{"".join(map(cell, r))}</row>' for i, r in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_NS[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def two_headers(df: DataFrame, rows: int = 2) -> DataFrame:
    """The columns named by the first two rows (a group's name reaches over the empty cells to its right), the rows below them left.

    The driver reads the two header rows only.
    """
    from .readers import flatten_header

    cols = [c for c in df.columns if c != "row"]
    head = df.where(F.col("row") <= rows).orderBy("row").collect()
    names = flatten_header([head[0][c] for c in cols], [head[1][c] for c in cols])
    return df.where(F.col("row") > rows).select("row", *(F.col(c).alias(n or c) for c, n in zip(cols, names, strict=True)))


def column_by_prefix(df: DataFrame, prefix: str) -> str:
    """The only column whose name starts with prefix."""
    found = [c for c in df.columns if c.lower().startswith(prefix.lower())]
    if len(found) != 1:
        raise KeyError(f"{len(found)} columns start with {prefix!r}")
    return found[0]

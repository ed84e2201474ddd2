"""Workbook folders → one long table per sheet.

``.xlsx``/``.xlsm`` files are zip archives of XML parts.  They are read with
``binaryFile`` and decoded inside ``mapInPandas`` with the standard library
(``zipfile`` + ``xml.etree``): each task decodes its own files and emits long rows
(file, sheet, table, row, col, value).  The output table name follows the reference:
the file stem for a one-sheet workbook, ``stem_sheet`` otherwise, with ``/`` and
``\\`` replaced by ``_``.  Legacy binary ``.xls`` is not decoded (listed as an error).
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
_REF = re.compile(r"([A-Z]+)(\d+)")

SCHEMA = ("file string, sheet string, table string, row int, col int, value string, "
          "status string")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def safe_table_name(stem: str, sheet: str, n_sheets: int) -> str:
    name = stem if n_sheets == 1 else f"{stem}_{sheet}"
    return name.replace("/", "_").replace("\\", "_")


def read_xlsx_bytes(name: str, data: bytes):
    """Yield (sheet, row, col, value) for every non-empty cell of a workbook."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        root = ET.fromstring(z.read("xl/sharedStrings.xml"))
        for si in root.findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.findall("pr:Relationship", _NS)}
    sheets = wb.findall("m:sheets/m:sheet", _NS)
    for sh in sheets:
        rid = sh.get(f"{{{_NS['r']}}}id")
        path = target[rid]
        path = path.lstrip("/") if path.startswith("/") else posixpath.normpath(posixpath.join("xl", path))
        root = ET.fromstring(z.read(path))
        for c in root.iter(f"{{{_NS['m']}}}c"):
            m = _REF.match(c.get("r", ""))
            if not m:
                continue
            col, row = _col_index(m.group(1)), int(m.group(2)) - 1
            t = c.get("t")
            if t == "s":
                v = c.find("m:v", _NS)
                val = shared[int(v.text)] if v is not None else None
            elif t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
            else:
                v = c.find("m:v", _NS)
                val = v.text if v is not None else None
            if val is not None:
                yield sh.get("name"), len(sheets), row, col, val


def read_workbooks(spark: SparkSession, path, glob: str = "*.xls*") -> DataFrame:
    """Every cell of every sheet of the workbooks under ``path`` (plus a status per file)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path).select("path", "content"))

    def run(batches):
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                name = posixpath.basename(p)
                stem, ext = posixpath.splitext(name)
                if ext.lower() not in (".xlsx", ".xlsm"):
                    out.append((name, None, None, None, None, None, f"error: unsupported {ext}"))
                    continue
                try:
                    for sheet, n, r, c, v in read_xlsx_bytes(name, bytes(content)):
                        out.append((name, sheet, safe_table_name(stem, sheet, n), r, c, v, "ok"))
                except Exception as e:  # a broken file is reported, the others go on
                    out.append((name, None, None, None, None, None, f"error: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["file", "sheet", "table", "row", "col", "value", "status"])

    return files.mapInPandas(run, SCHEMA)


def workbook_tally(cells: DataFrame) -> DataFrame:
    """Files converted vs failed."""
    per_file = cells.groupBy("file").agg(F.max(F.col("status") != "ok").alias("failed"))
    return per_file.groupBy(F.when(F.col("failed"), "error").otherwise("ok").alias("status")) \
        .agg(F.count(F.lit(1)).alias("files"))

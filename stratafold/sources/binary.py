"""Shapefiles and workbooks, decoded from their bytes in Arrow batches, a file a row."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.session import reachable

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def shapes(data: bytes) -> Iterator[tuple[int, list[tuple[float, float]], float | None]]:
    """(kind, vertices, z) of each record of an SHP file: points 1, lines 3, polygons 5 and their forms with z."""
    at = 100
    while at + 8 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + size]
        kind = struct.unpack("<i", body[:4])[0]
        if kind in (1, 11, 21):
            x, y = struct.unpack("<2d", body[4:20])
            yield kind, [(x, y)], struct.unpack("<d", body[20:28])[0] if kind == 11 else None
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, n = struct.unpack("<2i", body[36:44])
            flat = struct.unpack(f"<{2 * n}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * n])
            yield kind, list(zip(flat[::2], flat[1::2])), None
        else:
            yield kind, [], None
        at += 8 + size


def read_shp(spark: SparkSession, path: str) -> DataFrame:
    """(record, geometry_type, x, y, z, length, area): points as they are, lines and polygons by centroid."""
    reachable(spark)

    def rows(batches):
        for b in batches:
            out = []
            for content in b.column(0).to_pylist():
                for i, (kind, v, z) in enumerate(shapes(content)):
                    length = sum(((c - a) ** 2 + (d - e) ** 2) ** 0.5 for (a, e), (c, d) in zip(v, v[1:]))
                    if kind % 10 == 5 and len(v) > 2:
                        cross = [a * d - c * e for (a, e), (c, d) in zip(v, v[1:] + v[:1])]
                        area = sum(cross) / 2
                        x = sum((a + c) * k for (a, _), (c, _), k in zip(v, v[1:] + v[:1], cross)) / (6 * area) if area else v[0][0]
                        y = sum((a + c) * k for (_, a), (_, c), k in zip(v, v[1:] + v[:1], cross)) / (6 * area) if area else v[0][1]
                        out.append((i, "Polygon", x, y, z, length, abs(area)))
                    elif kind % 10 == 3 and len(v) > 1:
                        steps = [(((c - a) ** 2 + (d - e) ** 2) ** 0.5, (a + c) / 2, (e + d) / 2) for (a, e), (c, d) in zip(v, v[1:])]
                        out.append((i, "LineString", sum(s * x for s, x, _ in steps) / (length or 1), sum(s * y for s, _, y in steps) / (length or 1), z, length, None))
                    elif v:
                        out.append((i, "Point", v[0][0], v[0][1], z, None, None))
            kinds = [pa.int64(), pa.string()] + [pa.float64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], ["record", "geometry_type", "x", "y", "z", "length", "area"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "record long, geometry_type string, x double, y double, z double, length double, area double")


def sheet_cells(data: bytes, sheet: int = 1) -> list[tuple[int, int, str]]:
    """(row, column, text) of the filled cells of a sheet of a workbook."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
    out = []
    for c in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{_NS}c"):
        letters, digits = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
        column = 0
        for ch in letters:
            column = column * 26 + ord(ch) - 64
        value = c.find(f"{_NS}v")
        text = shared[int(value.text)] if c.get("t") == "s" and value is not None else "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else value.text if value is not None else None
        if text not in (None, ""):
            out.append((int(digits), column, text))
    return out


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """A sheet as text columns. The header is the first of five rows of the filled box with mostly text; empty rows and columns go; error cells are null."""
    reachable(spark)

    def cells(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                found = sheet_cells(content, sheet)
                yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in found], pa.int64()), pa.array([c[1] for c in found], pa.int64()), pa.array([c[2] for c in found], pa.string())], ["row", "col", "text"])

    long = spark.read.format("binaryFile").load(path).select("content").mapInArrow(cells, "row long, col long, text string")
    top = long.orderBy("row", "col").where(F.col("row") < F.lit(5) + (long.agg(F.min("row")).first()[0] or 0)).collect()
    by: dict[int, dict[int, str]] = {}
    for r in top:
        by.setdefault(r.row, {})[r.col] = r.text
    numeric = re.compile(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?$")
    header = next((r for r, c in sorted(by.items()) if sum(not numeric.match(t) for t in c.values()) > len(c) / 2), min(by, default=0))
    names = {c: t.strip() for c, t in by.get(header, {}).items()}
    wide = long.where(F.col("row") > header).groupBy("row").agg(*(F.max(F.when(F.col("col") == c, F.col("text"))).alias(n) for c, n in sorted(names.items())))
    bad = ["", "NA", "N/A", "null", "NULL", "nan", "NaN", "-", "#N/A", "#VALUE!", "#REF!"]
    return wide.orderBy("row").select(*(F.when(~F.col(f"`{n}`").isin(*bad), F.col(f"`{n}`")).alias(n) for n in names.values()))

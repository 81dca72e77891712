"""Delimited text, well logs, placemarks, projects and databases as sources.

Sniffing reads a bounded head of a file by Spark's own reader, so any file system
will do; the data themselves are read by Spark's sources.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.operators.clean import NULL_TOKENS
from stratafold.session import settled, shared_folder

HEAD_BYTES = 10_000
DELIMITERS = ",;\t|"


def head(spark: SparkSession, path: str) -> bytes:
    """First bytes of a file, by Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readNBytes(HEAD_BYTES))
    finally:
        stream.close()


def encoding(raw: bytes) -> str:
    """UTF-8 unless its decoding fails before the cut end; then the Cyrillic code page."""
    if raw.startswith(b"\xff\xfe") or raw.startswith(b"\xfe\xff"):
        return "utf-16"
    try:
        raw[: max(len(raw) - 4, 0)].decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        return "utf-8" if e.start >= len(raw) - 8 else "windows-1251"


def delimiter(text: str) -> str:
    try:
        return csv.Sniffer().sniff(text, delimiters=",;\t| ").delimiter
    except csv.Error:
        line = text.split("\n", 1)[0]
        best = max(DELIMITERS, key=line.count)
        return best if line.count(best) else ","


def header_row(text: str, sep: str) -> int:
    """First of eleven rows with several cells of which more than half are no numbers, else 0."""
    def numeric(cell: str) -> bool:
        try:
            float(cell)
            return True
        except ValueError:
            return False

    for i, line in enumerate(text.splitlines()[:11]):
        cells = [c.strip() for c in line.split(sep)]
        if len(cells) > 1 and sum(not numeric(c) for c in cells) > len(cells) / 2:
            return i
    return 0


def read_csv(spark: SparkSession, path: str, limit: int | None = None, **given) -> DataFrame:
    """A file of delimited text with sniffed encoding, delimiter and header; all columns text, null tokens null, lines before the header left out."""
    raw = head(spark, path)
    code = given.get("encoding") or encoding(raw)
    text = raw.decode(code, "replace").lstrip("﻿")
    if not text.strip():
        raise ValueError(f"{path} is empty")
    sep = given.get("sep") or delimiter(text)
    at = given.get("header", header_row(text, sep))
    names = [c.strip() or f"column_{i}" for i, c in enumerate(next(csv.reader([text.splitlines()[at]], delimiter=sep)))]
    single = code.lower() not in ("utf-8", "utf-16", "iso-8859-1", "us-ascii")  # read byte for byte, then translated
    rows = spark.read.csv(path, sep=sep, encoding="iso-8859-1" if single else code, header=at == 0, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, schema=", ".join(f"`{c}` string" for c in names), enforceSchema=True)
    if at:
        # by place: the first lines of the file's first block, blank ones not counted, are those above the data
        above = sum(bool(line.strip()) for line in text.splitlines()[: at + 1])
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        rows = rows.select("*", F.col("_metadata.file_block_start").alias("_block")).withColumn("_place", place).where((F.col("_block") > 0) | (F.col("_place") >= above)).drop("_block", "_place")
    if single:
        high = bytes(range(128, 256))
        rows = rows.select(*(F.translate(f"`{c}`", high.decode("latin-1"), high.decode(code, "replace")).alias(c) for c in names))
    rows = rows.select(*(F.when(F.trim(f"`{c}`").isin(*NULL_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in names))
    return rows.limit(limit) if limit is not None else rows


def file_info(spark: SparkSession, path: str) -> dict:
    raw = head(spark, path)
    text = raw.decode(encoding(raw), "replace")
    sep = delimiter(text)
    size = spark.read.format("binaryFile").load(path).select("length").first()[0]
    at = header_row(text, sep)
    return {"size": size, "encoding": encoding(raw), "delimiter": sep, "header": at, "lines": spark.read.text(path).count(), "columns": [c.strip() for c in text.splitlines()[at].split(sep)]}


def las_kind(text: str) -> bool:
    return text.lstrip()[:1] == "~" and "vers" in text.lower()


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """A well log: one column per curve, the header's null value null. Sections go by the first letter after the tilde."""
    text = head(spark, path).decode("utf-8", "replace")
    section, curves, missing = "", [], -999.25
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("~"):
            section = line[1:2].upper()
            if section == "A":
                break
        elif line and not line.startswith("#"):
            name = re.match(r"([^.\s]+)\s*\.", line)
            if section == "C" and name:
                curves.append(name[1].strip())
            elif section == "W" and name and name[1].strip().upper() == "NULL":
                missing = float(re.findall(r"-?\d+(?:\.\d+)?", line.split(".", 1)[1])[0])
    if not curves:
        raise ValueError(f"{path} has no curve section")
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(cells.alias("c")).where(F.size("c") == len(curves))
    numbers = [F.get("c", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(curves)]
    rows = rows.select(*numbers).where(F.col(f"`{curves[0]}`").isNotNull())
    return rows.select(*(F.when(F.col(f"`{c}`") != missing, F.col(f"`{c}`")).alias(c) for c in curves))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks: name, description, kind, first vertex and number of vertices, polygon rings included."""
    fields = "name string, description string, Point struct<coordinates:string>, LineString struct<coordinates:string>, Polygon struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>"
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(fields).load(path)
    text = F.coalesce("Point.coordinates", "LineString.coordinates", "Polygon.outerBoundaryIs.LinearRing.coordinates")
    kind = F.when(F.col("Point").isNotNull(), "Point").when(F.col("LineString").isNotNull(), "LineString").when(F.col("Polygon").isNotNull(), "Polygon")
    rows = rows.select("name", "description", kind.alias("geometry_type"), F.split(F.trim(text), r"\s+").alias("v"))
    first = F.split(F.get("v", F.lit(0)), ",")
    at = lambda i: F.get(first, F.lit(i)).try_cast("double")
    return rows.select("name", "description", "geometry_type", at(0).alias("x"), at(1).alias("y"), F.coalesce(at(2), F.lit(0.0)).alias("z"), F.size("v").cast("long").alias("vertex_count"))


def read_kmz(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of the first KML document of a zipped one, unpacked to the shared folder while it is read."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    book = zipfile.ZipFile(io.BytesIO(data))
    name = next((n for n in book.namelist() if n.lower().endswith(".kml")), None)
    if name is None:
        raise ValueError(f"{path} holds no KML document")
    plain = f"{shared_folder(spark).rstrip('/')}/kmz-{uuid.uuid4().hex}.kml"
    p = spark._jvm.org.apache.hadoop.fs.Path(plain)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = files.create(p, True)
    try:
        stream.write(bytearray(book.read(name)))
    finally:
        stream.close()
    out = settled(read_kml(spark, plain))
    files.delete(p, False)
    return out


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON project: its ``data`` array as rows."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("data").alias("r")).select("r.*")


def read_table(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, where: str | None = None, limit: int | None = None, **options) -> DataFrame:
    """A database table by JDBC; columns, filter and limit are pushed down by Spark."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    rows = rows.where(where) if where else rows
    rows = rows.select(*columns) if columns else rows
    return rows.limit(limit) if limit is not None else rows


def jdbc_url(kind: str, **c) -> str:
    """Address of a database by its kind or an alias."""
    kinds = {"postgresql": "postgresql", "postgres": "postgresql", "pg": "postgresql", "mssql": "sqlserver", "sqlserver": "sqlserver", "sqlite": "sqlite"}
    k = kinds[kind.lower()]
    if k == "sqlite":
        return f"jdbc:sqlite:{c['database']}"
    port = c.get("port", 5432 if k == "postgresql" else 1433)
    return f"jdbc:{k}://{c['host']}:{port}" + (f"/{c['database']}" if k == "postgresql" else f";databaseName={c['database']}")


def read_geological(spark: SparkSession, path: str) -> DataFrame:
    """A reader by extension."""
    kind = path.rsplit(".", 1)[-1].lower()
    readers = {"las": read_las, "kml": read_kml, "kmz": read_kmz, "csv": read_csv, "txt": read_csv, "tsv": read_csv, "json": read_project}
    if kind in ("shp", "xlsx"):
        from stratafold.sources.binary import read_shp, read_xlsx

        readers |= {"shp": read_shp, "xlsx": read_xlsx}
    if kind not in readers:
        raise ValueError(f"no reader for .{kind}")
    return readers[kind](spark, path)

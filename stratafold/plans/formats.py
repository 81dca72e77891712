"""Queries of sources and sinks: tables of bounded size are written to the shared folder, read back, and compared as tables."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.model import Grid
from stratafold.operators import clean, grid, more, panels
from stratafold.plans.queries import R, register
from stratafold.plans.tables import part_points, table, with_
from stratafold.session import settled, shared_folder
from stratafold.sources import binary, reports, sinks, text

_BOX = Grid(bounds=(0.0, 24.0, 0.0, 14.0), nx=25, ny=15)
_VALUE = "CASE WHEN (ix * 7 + iy * 3) % 11 = 0 THEN NULL ELSE ix * 0.5 + iy END"
_CELLS = "(SELECT i % 25 AS ix, i // 25 AS iy FROM range(375) t(i))"


@contextmanager
def _folder(spark: SparkSession):
    name = f"{shared_folder(spark).rstrip('/')}/formats-{uuid.uuid4().hex}"
    yield name
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _nodes(s: SparkSession) -> DataFrame:
    return grid.regular(s, _BOX).withColumn("value", F.expr(_VALUE).cast("double"))


def _bytes(s: SparkSession, path: str) -> bytes:
    return bytes(s.read.format("binaryFile").load(path).first().content)


def _cells(s: SparkSession, rows) -> DataFrame:
    return s.createDataFrame(list(rows), "ix long, iy long, value double")


def _grid_sql(known: bool = False) -> str:
    return f"SELECT * FROM (SELECT ix, iy, {R(_VALUE, 'value')} FROM {_CELLS})" + (" WHERE value IS NOT NULL" if known else "")


# --- delimited text ----------------------------------------------------------------------------------------------


@register("csv_points", with_("pt") + f"SELECT id, {R('x', 'x')}, {R('value', 'value')}, domain, 'made' AS meta_origin FROM pt")
def _(s, d):
    with _folder(s) as folder:
        sinks.write_csv(part_points(s, d).select("id", "x", "value", "domain"), f"{folder}/p", meta={"origin": "made"})
        rows = s.read.csv(f"{folder}/p", header=True)
        return settled(rows.select(F.col("id").cast("long"), clean.number("x").alias("x"), clean.number("value").alias("value"), "domain", "meta_origin"))


_LINES = "station;east;north;au\n1;10,5;2;0.1\n2;NA;3;-\n3;11,5;;0.3\n"


@register("csv_sniffed", "SELECT * FROM (VALUES ('1', '10,5', '2', '0.1'), ('2', NULL, '3', NULL), ('3', '11,5', NULL, '0.3')) t(station, east, north, au)")
def _(s, d):
    """Header below a title; rows that equal the lines above the header are data."""
    with _folder(s) as folder:
        sinks.put(s, f"{folder}/a.csv", _LINES.encode())
        return settled(text.read_csv(s, f"{folder}/a.csv"))


@register("csv_encodings", "SELECT * FROM (VALUES ('cyrillic', 'windows-1251', ';', 'скважина'), ('utf-8', 'utf-8', ',', 'скважина'), ('tab', 'utf-8', chr(9), 'well')) t(file, encoding, delimiter, first_column)")
def _(s, d):
    files = {"cyrillic": "скважина;x\nодин;1\nдва;2\n".encode("windows-1251"), "utf-8": "скважина,x\nодин,1\nдва,2\n".encode(), "tab": b"well\tx\na\t1\nb\t2\n"}
    with _folder(s) as folder:
        out = []
        for name, data in files.items():
            sinks.put(s, f"{folder}/{name}.csv", data)
            found = text.file_info(s, f"{folder}/{name}.csv")
            out.append((name, found["encoding"], found["delimiter"], found["columns"][0]))
        return s.createDataFrame(out, "file string, encoding string, delimiter string, first_column string")


@register("csv_header_place", "SELECT * FROM (VALUES ('1', '2.5'), ('title', 'made'), ('3', '4.5')) t(well, grade)")
def _(s, d):
    with _folder(s) as folder:
        sinks.put(s, f"{folder}/a.csv", b"7,8\nwell,grade\n1,2.5\ntitle,made\n3,4.5\n")
        return settled(text.read_csv(s, f"{folder}/a.csv"))


@register("csv_preview", "SELECT * FROM (VALUES ('1', '10,5', '2', '0.1'), ('2', NULL, '3', NULL)) t(station, east, north, au)")
def _(s, d):
    with _folder(s) as folder:
        sinks.put(s, f"{folder}/a.csv", _LINES.encode())
        return settled(text.read_csv(s, f"{folder}/a.csv", limit=2))


@register("export_summary", with_("pt") + f"SELECT count(*) AS n, {', '.join(R(f'{f}({c})', f'{c}_{f}') for c in ('x', 'y', 'value') for f in ('min', 'max'))} FROM pt")
def _(s, d):
    return sinks.summary(part_points(s, d))


# --- workbooks, logs, places, shapes, projects -------------------------------------------------------------------


@register("workbook_round_trip", "SELECT n_name, CAST(n_nationkey AS VARCHAR) AS n_nationkey FROM nation")
def _(s, d):
    with _folder(s) as folder:
        sinks.put(s, f"{folder}/a.xlsx", reports.workbook({"nation": table(s, d, "nation").select("n_name", F.col("n_nationkey").cast("string").alias("n_nationkey"))}))
        return settled(binary.read_xlsx(s, f"{folder}/a.xlsx").select("n_name", "n_nationkey"))


@register("well_log", f"SELECT {R('n_nationkey', 'DEPT')}, {R('CASE WHEN n_regionkey <> 3 THEN n_regionkey / 2.0 END', 'COAL')} FROM nation")
def _(s, d):
    rows = table(s, d, "nation").orderBy("n_nationkey").collect()
    body = "".join(f"{r.n_nationkey}.0 {-999.25 if r.n_regionkey == 3 else r.n_regionkey / 2}\n" for r in rows)
    with _folder(s) as folder:
        sinks.put(s, f"{folder}/a.las", f"~VERSION\nVERS. 2.0 :\n~WELL\nNULL. -999.25 :\n~CURVE\nDEPT.M :\nCOAL.PC :\n~ASCII\n{body}".encode())
        return settled(text.read_geological(s, f"{folder}/a.las"))


@register("coal_curves", "SELECT * FROM (VALUES ('ASH_PCT'), ('Coal'), ('gc_raw')) t(curve)")
def _(s, d):
    return s.createDataFrame([(c,) for c in panels.coal_curves(["DEPT", "ASH_PCT", "Coal", "gc_raw", "NPHI"])], "curve string")


@register("placemarks", f"SELECT n_name AS name, 'Point' AS geometry_type, {R('n_nationkey', 'x')}, {R('n_regionkey', 'y')}, {R('0', 'z')}, CAST(1 AS BIGINT) AS vertex_count FROM nation")
def _(s, d):
    rows = table(s, d, "nation").collect()
    marks = "".join(f"<Placemark><name>{r.n_name}</name><Point><coordinates>{r.n_nationkey},{r.n_regionkey}</coordinates></Point></Placemark>" for r in rows)
    with _folder(s) as folder:
        sinks.put(s, f"{folder}/a.kml", f"<kml><Document>{marks}</Document></kml>".encode())
        return settled(text.read_geological(s, f"{folder}/a.kml").drop("description"))


@register("zipped_placemarks", f"SELECT n_name AS name, {R('n_nationkey', 'x')}, {R('n_regionkey', 'y')} FROM nation")
def _(s, d):
    marks = "".join(f"<Placemark><name>{r.n_name}</name><Point><coordinates>{r.n_nationkey},{r.n_regionkey}</coordinates></Point></Placemark>" for r in table(s, d, "nation").collect())
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as book:
        book.writestr("doc.kml", f"<kml><Document>{marks}</Document></kml>")
    with _folder(s) as folder:
        sinks.put(s, f"{folder}/a.kmz", packed.getvalue())
        return settled(text.read_geological(s, f"{folder}/a.kmz").select("name", "x", "y"))


@register("shapes", f"SELECT CAST(n_nationkey AS BIGINT) AS record, 'Point' AS geometry_type, {R('n_nationkey / 2', 'x')}, {R('n_regionkey', 'y')} FROM nation")
def _(s, d):
    rows = table(s, d, "nation").orderBy("n_nationkey").collect()
    body = b"".join(struct.pack(">2i", i + 1, 10) + struct.pack("<i2d", 1, r.n_nationkey / 2, r.n_regionkey) for i, r in enumerate(rows))
    with _folder(s) as folder:
        sinks.put(s, f"{folder}/a.shp", bytes(100) + body)
        return settled(text.read_geological(s, f"{folder}/a.shp").select("record", "geometry_type", "x", "y"))


@register("project_round_trip", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name FROM supplier")
def _(s, d):
    with _folder(s) as folder:
        sinks.save_project(table(s, d, "supplier").select("s_suppkey", "s_name"), f"{folder}/p", {"power": 2})
        return settled(text.read_project(s, f"{folder}/p").select("s_suppkey", "s_name"))


# --- grids -------------------------------------------------------------------------------------------------------


@register("surfer_text", _grid_sql())
def _(s, d):
    lines = sinks.surfer_ascii(_nodes(s)).decode().split("\n")[5:]
    return _cells(s, ((x, y, None if float(v) > 1e38 else float(v)) for y, line in enumerate(lines) if line for x, v in enumerate(line.split())))


@register("surfer_binary", _grid_sql())
def _(s, d):
    with _folder(s) as folder:
        sinks.put(s, f"{folder}/a.grd", sinks.surfer_binary(_nodes(s)))
        data = _bytes(s, f"{folder}/a.grd")
    values = struct.unpack("<375f", data[-1500:])
    return _cells(s, ((i % 25, i // 25, None if v > 1e38 else float(v)) for i, v in enumerate(values)))


@register("vtk_grid", _grid_sql())
def _(s, d):
    with _folder(s) as folder:
        reports.write(_nodes(s), f"{folder}/a.vtk")
        lines = _bytes(s, f"{folder}/a.vtk").decode().split("LOOKUP_TABLE default\n")[1].split()
    return _cells(s, ((i % 25, i // 25, None if v == "nan" else float(v)) for i, v in enumerate(lines)))


@register("vtk_points", f"SELECT CAST(n_nationkey AS DOUBLE) AS x, CAST(n_regionkey AS DOUBLE) AS y, {R('n_nationkey * 2', 'value')} FROM nation")
def _(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"), (F.col("n_nationkey") * 2.0).alias("value"))
    with _folder(s) as folder:
        sinks.write_vtk_points(n, f"{folder}/a.vtk")
        lines = _bytes(s, f"{folder}/a.vtk").decode().split("\n")
    places, values = lines[5:30], lines[lines.index("LOOKUP_TABLE default") + 1 :]
    return s.createDataFrame([(*map(float, p.split()[:2]), float(v)) for p, v in zip(places, values)], "x double, y double, value double")


@register("dxf_points", f"SELECT {R('ix', 'x')}, {R('iy', 'y')}, value FROM ({_grid_sql(True)})")
def _(s, d):
    with _folder(s) as folder:
        reports.write(_nodes(s), f"{folder}/a.dxf")
        parts = _bytes(s, f"{folder}/a.dxf").decode().split("0\nPOINT\n")[1:]
    return s.createDataFrame([tuple(map(float, p.split("\n")[3:8:2])) for p in parts], "x double, y double, value double")


@register("dxf_metadata", "SELECT * FROM (VALUES ('method: kriging'), ('points: 25')) t(line)")
def _(s, d):
    body = sinks.dxf_points(_nodes(s), {"method": "kriging", "points": 25}).decode()
    return s.createDataFrame([(p.split("\n")[9],) for p in body.split("0\nTEXT\n")[1:]], "line string")


@register("geotiff_grid", _grid_sql())
def _(s, d):
    with _folder(s) as folder:
        reports.write(_nodes(s), f"{folder}/a.tif")
        data = _bytes(s, f"{folder}/a.tif")
    values = struct.unpack("<375d", data[-3000:])
    return _cells(s, ((i % 25, 14 - i // 25, None if v == -9999 else v) for i, v in enumerate(values)))


@register("netcdf_grid", _grid_sql())
def _(s, d):
    with _folder(s) as folder:
        reports.write(_nodes(s), f"{folder}/a.nc")
        data = _bytes(s, f"{folder}/a.nc")
    values = struct.unpack(">375d", data[-3000:])
    return _cells(s, ((i % 25, i // 25, None if v > 1e36 else v) for i, v in enumerate(values)))


@register("voxler_points", with_("pt") + f"SELECT {R('x', 'x')}, {R('y', 'y')}, {R('0', 'z')}, {R('value', 'value')} FROM pt")
def _(s, d):
    with _folder(s) as folder:
        reports.write_voxler(part_points(s, d), f"{folder}/v")
        return settled(s.read.csv(f"{folder}/v", header=True, inferSchema=True).select(*(F.col(c).cast("double") for c in ("x", "y", "z", "value"))))


@register("color_numbers", f"SELECT ix, iy, CAST(floor((value - 0.5) / (26.0 - 0.5) * 254) + 1 AS BIGINT) AS color FROM (SELECT ix, iy, {_VALUE} AS value FROM {_CELLS}) WHERE value IS NOT NULL")
def _(s, d):
    return grid.color_index(_nodes(s).where("value is not null")).select("ix", "iy", "color")


@register("grid_facts", "SELECT CAST(25 AS BIGINT) AS nx, CAST(15 AS BIGINT) AS ny, CAST(1.0 AS DOUBLE) AS dx, CAST(1.0 AS DOUBLE) AS dy, CAST(375 AS BIGINT) AS nodes, false AS many")
def _(s, d):
    i = grid.info(_BOX)
    return s.createDataFrame([tuple(i[k] for k in ("nx", "ny", "dx", "dy", "nodes", "many"))], "nx long, ny long, dx double, dy double, nodes long, many boolean")


@register("report_files", "SELECT * FROM (VALUES ('docx', 'PK'), ('html', '<h'), ('pdf', '%P'), ('xlsx', 'PK')) t(kind, head)")
def _(s, d):
    out = []
    with _folder(s) as folder:
        for kind in ("html", "xlsx", "docx", "pdf"):
            reports.write_report(s, "nations", {"nation": table(s, d, "nation")}, f"{folder}/r.{kind}")
            out.append((kind, _bytes(s, f"{folder}/r.{kind}")[:2].decode("latin-1")))
    return s.createDataFrame(out, "kind string, head string")


@register("writers", "SELECT unnest(['csv', 'dxf', 'grd', 'json', 'nc', 'parquet', 'tif', 'tsv', 'vtk', 'xlsx']) AS extension")
def _(s, d):
    return s.createDataFrame([(k,) for k in reports.supported()], "extension string")


@register("registered_writer", "SELECT r_regionkey, r_name FROM region")
def _(s, d):
    reports.register_writer("lines", lambda df, path: df.write.mode("overwrite").option("header", True).csv(path))
    try:
        with _folder(s) as folder:
            reports.write(table(s, d, "region"), f"{folder}/a.lines")
            return settled(s.read.csv(f"{folder}/a.lines", header=True).select(F.col("r_regionkey").cast("int"), "r_name"))
    finally:
        reports.REGISTRY.pop("lines")


# --- catalogue and databases -------------------------------------------------------------------------------------


@register("table_facts", "SELECT c AS \"column\", (SELECT count(*) FROM orders) AS n_rows FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS c)")
def _(s, d):
    return more.table_info(table(s, d, "orders")).select("column", "n_rows")


@register("listed_tables", "SELECT 'stratafold_nations' AS name, 'TEMPORARY' AS kind")
def _(s, d):
    table(s, d, "nation").createOrReplaceTempView("stratafold_nations")
    out = settled(more.tables(s).where("name = 'stratafold_nations'"))
    s.catalog.dropTempView("stratafold_nations")
    return out


@register("spatial_table_statements", "SELECT * FROM (VALUES ('CREATE TABLE IF NOT EXISTS wells (id INTEGER, au REAL)'), ('SELECT AddGeometryColumn(''wells'', ''geom'', 4326, ''POINT'', 2)')) t(statement)")
def _(s, d):
    return s.createDataFrame([(t,) for t in more.create_table_sql("wells", {"id": "INTEGER", "au": "REAL"})], "statement string")


@register("database_addresses", "SELECT * FROM (VALUES ('pg', 'jdbc:postgresql://h:5432/d'), ('mssql', 'jdbc:sqlserver://h:1433;databaseName=d'), ('sqlite', 'jdbc:sqlite:d')) t(kind, url)")
def _(s, d):
    return s.createDataFrame([(k, text.jdbc_url(k, host="h", database="d")) for k in ("pg", "mssql", "sqlite")], "kind string, url string")

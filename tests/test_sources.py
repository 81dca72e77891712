"""Readers, writers and streams."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from stratafold.model import Grid
from stratafold.operators import grid
from stratafold.sources import binary, sinks, text
from stratafold.streaming import windows


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_csv_sniffing(spark, tmp_path):
    a = text.read_csv(spark, put(tmp_path / "a.csv", "X;Y;ASH\n1;2;3,5\n4; NA;-\n"))
    assert a.columns == ["X", "Y", "ASH"] and [tuple(r) for r in a.collect()] == [("1", "2", "3,5"), ("4", None, None)]
    b = text.read_csv(spark, put(tmp_path / "b.csv", "Report\nmade today\n\nX,Y,Z\n1,2,3\n4,5,6\n"))
    assert [tuple(r) for r in b.orderBy("X").collect()] == [("1", "2", "3"), ("4", "5", "6")]
    c = text.read_csv(spark, put(tmp_path / "c.csv", "Имя,Зола\nа,1\n".encode("windows-1251")))
    assert c.columns == ["Имя", "Зола"] and c.first()[0] == "а"
    with pytest.raises(ValueError):
        text.read_csv(spark, put(tmp_path / "d.csv", ""))
    assert text.file_info(spark, str(tmp_path / "a.csv"))["columns"] == ["X", "Y", "ASH"] and text.read_csv(spark, str(tmp_path / "a.csv"), limit=1).count() == 1


def test_las_and_kml(spark, tmp_path):
    las = "~VERSION INFORMATION\n VERS. 2.0 : v\n~WELL\n NULL. -999.25 : null\n~CURVE INFORMATION\n DEPT.M : depth\n GR .API : gamma\n~A\n 1.0 50\n 1.5 -999.25\n bad line\n"
    got = text.read_geological(spark, put(tmp_path / "w.las", las))
    assert got.columns == ["DEPT", "GR"] and [tuple(r) for r in got.orderBy("DEPT").collect()] == [(1.0, 50.0), (1.5, None)] and text.las_kind(las)
    kml = "<kml><Document><Placemark><name>a</name><Point><coordinates>1,2</coordinates></Point></Placemark><Placemark><name>b</name><Polygon><outerBoundaryIs><LinearRing><coordinates>3,4,5 6,7,8</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"
    rows = {r.name: (r.geometry_type, r.x, r.y, r.z, r.vertex_count) for r in text.read_geological(spark, put(tmp_path / "p.kml", kml)).collect()}
    assert rows == {"a": ("Point", 1.0, 2.0, 0.0, 1), "b": ("Polygon", 3.0, 4.0, 5.0, 2)}


def test_shapefile(spark, tmp_path):
    def record(n, body):
        return struct.pack(">2i", n, len(body) // 2) + body

    square = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    poly = struct.pack("<i4d2ii", 5, 0, 0, 2, 2, 1, 5, 0) + b"".join(struct.pack("<2d", *p) for p in square)
    data = bytes(100) + record(1, struct.pack("<i2d", 1, 3.0, 4.0)) + record(2, poly)
    got = {r.record: (r.geometry_type, r.x, r.y, r.length, r.area) for r in text.read_geological(spark, put(tmp_path / "s.shp", data)).collect()}
    assert got == {0: ("Point", 3.0, 4.0, None, None), 1: ("Polygon", 1.0, 1.0, 8.0, 4.0)}


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = {"B2": "X", "C2": "Y", "B3": 1, "C3": 2.5, "B5": 3, "C5": "#N/A"}
    strings = [v for v in cells.values() if isinstance(v, str)]
    sheet = "".join(f'<c r="{k}" t="s"><v>{strings.index(v)}</v></c>' if isinstance(v, str) else f'<c r="{k}"><v>{v}</v></c>' for k, v in cells.items())
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData><row>{sheet}</row></sheetData></worksheet>")
    got = binary.read_xlsx(spark, str(tmp_path / "b.xlsx"))
    assert got.columns == ["X", "Y"] and sorted(map(tuple, got.collect())) == [("1", "2.5"), ("3", None)]


def test_sinks(spark, tmp_path):
    g = grid.regular(spark, Grid(bounds=(0, 2, 0, 1), nx=3, ny=2)).withColumn("value", F.when(F.col("id") != 4, F.col("id").cast("double")))
    for name in ("g.grd", "g.vtk", "g.dxf", "g.tif"):
        sinks.export_grid(g, str(tmp_path / name))
    assert (tmp_path / "g.grd").read_text().splitlines()[:4] == ["DSAA", "3 2", "0.0 2.0", "0.0 1.0"] and "1.70141e+38" in (tmp_path / "g.grd").read_text()
    assert "DIMENSIONS 3 2 1" in (tmp_path / "g.vtk").read_text() and (tmp_path / "g.dxf").read_text().count("POINT") == 5
    tif = (tmp_path / "g.tif").read_bytes()
    assert tif[:4] == b"II*\0" and struct.unpack("<6d", tif[-48:]) == (3.0, -9999.0, 5.0, 0.0, 1.0, 2.0)
    nc = sinks.netcdf(g)
    assert nc[:4] == b"CDF\x01" and struct.unpack(">11d", nc[-88:])[:5] == (0.0, 1.0, 2.0, 0.0, 1.0) and struct.unpack(">6d", nc[-48:])[5] == 5.0
    begins = [struct.unpack(">i", nc[i + 8 : i + 12])[0] for i in range(len(nc) - 88 - 11) if nc[i : i + 4] == struct.pack(">i", 6) and struct.unpack(">i", nc[i + 4 : i + 8])[0] in (24, 16, 48)]
    assert begins == [len(nc) - 88, len(nc) - 64, len(nc) - 48]
    assert sinks.surfer_binary(g)[:8] == b"DSBB" + struct.pack("<2h", 3, 2)
    sinks.write_csv(g.select("x", "value"), str(tmp_path / "csv"), decimal=",", sep=";", meta={"m": "k"})
    assert ("0,000000", "0,000000", "k") in set(map(tuple, spark.read.csv(str(tmp_path / "csv"), sep=";", header=True).collect()))
    sinks.save_project(g.select("x", "value"), str(tmp_path / "p"), {"power": 2})
    assert text.read_project(spark, str(tmp_path / "p")).count() == 6
    assert sinks.summary(g).first().n == 6 and "<table>" in sinks.report("t", {"s": sinks.summary(g)})
    assert text.jdbc_url("postgres", host="h", database="d") == "jdbc:postgresql://h:5432/d"
    with pytest.raises(ValueError):
        sinks.export_grid(g, str(tmp_path / "g.nope"))


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.windowed(windows.replay(events, str(tmp_path / "in")), "ts", "value", "event_type", "1 hour")
    query = stream.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = windows.windowed(events, "ts", "value", "event_type", "1 hour")
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r["mean"], 6)) for r in df.collect())
    assert key(spark.table("hours")) == key(batch)
    assert sum(r.n for r in windows.sessions(events, "ts", "user_id", "30 minutes").collect()) == events.count()


def test_running_moments(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").limit(300)
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    out = windows.running_moments(windows.replay(events, str(tmp_path / "in")), "event_type", "value")
    query = out.writeStream.format("memory").queryName("moments").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for r in spark.table("moments").collect():
        if r.n > last.get(r.key, (0,))[0]:
            last[r.key] = (r.n, r["mean"], r.variance)
    for r in spark.read.parquet(str(tmp_path / "in")).groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")).collect():
        assert last[r.event_type] == pytest.approx((r.n, r.m, r.v))

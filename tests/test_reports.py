"""Reports, the registry of writers and the data source."""

import io
import zipfile
from xml.etree import ElementTree

import pytest

from stratafold.sources import reports
from stratafold.sources.binary import read_xlsx, sheet_cells


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, 0.5, "a & <b>"), (2, None, "c (d)")], "id long, v double, name string")


def test_workbook_reads_back(spark, small, tmp_path):
    path = f"{tmp_path}/w.xlsx"
    reports.write(small, path)
    with open(path, "rb") as f:
        assert (2, 3, "a & <b>") in sheet_cells(f.read())
    assert {(r.id, r.v, r.name) for r in read_xlsx(spark, path).collect()} == {("1", "0.5", "a & <b>"), ("2", None, "c (d)")}
    assert [reports.column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_documents_and_pages(spark, small, tmp_path):
    for kind in ("html", "xlsx", "docx", "pdf"):
        reports.write_report(spark, "Title", {"first": small, "second": small}, f"{tmp_path}/r.{kind}")
    book = zipfile.ZipFile(f"{tmp_path}/r.docx")
    text = "".join(t.text or "" for t in ElementTree.fromstring(book.read("word/document.xml")).iter() if t.tag.endswith("}t"))
    assert text.startswith("Titlefirstidvname10.500a & <b>2N/Ac (d)")
    for name in zipfile.ZipFile(f"{tmp_path}/r.xlsx").namelist():
        ElementTree.fromstring(zipfile.ZipFile(f"{tmp_path}/r.xlsx").read(name))
    with open(f"{tmp_path}/r.pdf", "rb") as f:
        pdf = f.read()
    at = int(pdf.rsplit(b"startxref\n", 1)[1].split()[0])
    assert pdf[at:].startswith(b"xref") and b"c \\(d\\)" in pdf
    for i, line in enumerate(pdf[at:].splitlines()[3:-5], 1):
        assert pdf[int(line[:10]) :].startswith(f"{i} 0 obj".encode())
    with pytest.raises(ValueError, match="no report"):
        reports.write_report(spark, "t", {}, "x.doc")
    with pytest.raises(ValueError, match="at most"):
        reports.workbook({"big": spark.range(reports.ROWS + 1)})


def test_registry(spark, small, tmp_path):
    seen = []
    reports.register_writer(".own", lambda df, path: seen.append((df.count(), path)))
    reports.write(small, "a.own")
    assert seen == [(2, "a.own")] and {"own", "csv", "grd", "xlsx"} <= set(reports.supported())
    points = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, value double").coalesce(1)
    reports.write_voxler(points, f"{tmp_path}/v")
    assert [r.value for r in spark.read.text(f"{tmp_path}/v").collect()] == ["x,y,z,value", "1.000000,2.000000,0.000000,3.000000"]
    reports.write_grapher(points, f"{tmp_path}/g")
    assert spark.read.text(f"{tmp_path}/g").first().value == "x\ty\tvalue"
    with pytest.raises(ValueError, match="no writer"):
        reports.write(points, "a.unknown")


def test_data_source(spark):
    spark.dataSource.register(reports.WellLogs)
    log = "~V\nVERS. 2.0:\n~W\nNULL. -999.25:\n~C\nDEPT.M:\nGR.API:\nASH.PCT:\n~A\n1.0 50 -999.25\n2.0 60 12\n"
    rows = spark.read.format("well_log").option("text", log).load().collect()
    assert {(r.depth, r.curve, r.value) for r in rows} == {(1.0, "GR", 50.0), (1.0, "ASH", None), (2.0, "GR", 60.0), (2.0, "ASH", 12.0)}
    assert spark.read.format("well_log").load().count() == 0

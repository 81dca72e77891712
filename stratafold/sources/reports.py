"""Reports of small result tables as workbooks, text documents and pages; a registry of writers; a data source for well logs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratafold.sources import sinks
from stratafold.sources.sinks import put, small_rows

ROWS = 10_000
LINES_A_PAGE, PAGE_WIDTH, PAGE_HEIGHT = 60, 595, 842


def _text(v) -> str:
    return "N/A" if v is None or v != v else f"{v:.3f}" if isinstance(v, float) else str(v)


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), f'<?xml version="1.0" encoding="UTF-8"?>\n{body}')
    return out.getvalue()


def _relations(*targets: tuple[str, str]) -> str:
    base = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"""<Relationship Id="rId{i}" Type="{base}/{kind}" Target="{t}"/>""" for i, (kind, t) in enumerate(targets, 1))}</Relationships>'


def _types(*parts: tuple[str, str]) -> str:
    own = "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for p, t in parts)
    return f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{own}</Types>'


def column_letters(i: int) -> str:
    """Name of a sheet's column, from 0 on."""
    out, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(sections: dict[str, DataFrame]) -> bytes:
    """A sheet for each table, numbers as numbers; missing values are empty cells."""

    def cell(r: int, c: int, v) -> str:
        at = f"{column_letters(c)}{r}"
        if v is None or v != v:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    parts, names = {}, list(sections)
    for i, df in enumerate(sections.values(), 1):
        rows = [df.columns, *small_rows(df, ROWS)]
        body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>'
    sheets = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    return _zipped({
        "[Content_Types].xml": _types(("xl/workbook.xml", "spreadsheetml.sheet.main"), *((p, "spreadsheetml.worksheet") for p in parts)),
        "_rels/.rels": _relations(("officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{ns}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _relations(*(("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(names) + 1))),
    } | parts)


def document(title: str, sections: dict[str, DataFrame]) -> bytes:
    """A text document: a heading and a table for each section."""
    paragraph = lambda t, bold=False: f'<w:p><w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    body = paragraph(title, True)
    for name, df in sections.items():
        rows = [df.columns, *small_rows(df, ROWS)]
        table = "".join(f"<w:tr>{''.join(f'<w:tc>{paragraph(_text(v), r == 0)}</w:tc>' for v in row)}</w:tr>" for r, row in enumerate(rows))
        body += paragraph(name, True) + f"<w:tbl>{table}</w:tbl>" + paragraph("")
    return _zipped({
        "[Content_Types].xml": _types(("word/document.xml", "wordprocessingml.document.main")),
        "_rels/.rels": _relations(("officeDocument", "word/document.xml")),
        "word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    })


def pages(title: str, sections: dict[str, DataFrame]) -> bytes:
    """A PDF of the tables in a fixed-width font, LINES_A_PAGE lines a page; characters outside Latin-1 become question marks."""
    lines = [title, ""]
    for name, df in sections.items():
        rows = [[_text(v) for v in row] for row in [df.columns, *small_rows(df, ROWS)]]
        widths = [max(map(len, column)) for column in zip(*rows)]
        lines += [name, *("  ".join(v.ljust(w) for v, w in zip(row, widths)).rstrip() for row in rows), ""]
    sheets = [lines[i : i + LINES_A_PAGE] for i in range(0, len(lines), LINES_A_PAGE)]
    quoted = lambda t: t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").replace("\n", " ").encode("latin-1", "replace")
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(sheets)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(sheets)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    for i, sheet in enumerate(sheets):
        stream = b"BT /F1 8 Tf 12 TL 40 800 Td\n" + b"".join(b"(" + quoted(t) + b") Tj T*\n" for t in sheet) + b"ET"
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {PAGE_WIDTH} {PAGE_HEIGHT}] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
        objects.append(f"<< /Length {len(stream)} >>\nstream\n".encode() + stream + b"\nendstream")
    out, starts = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        starts.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{at:010d} 00000 n \n" for at in starts)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


# --- registry ------------------------------------------------------------------------------------------------------

#: Writers by extension: (table, path) -> None. Grid formats come from the grid sinks.
REGISTRY: dict[str, Callable[[DataFrame, str], None]] = {
    "csv": sinks.write_csv,
    "tsv": lambda df, path: sinks.write_csv(df, path, sep="\t"),
    "json": lambda df, path: df.write.mode("overwrite").json(path),
    "parquet": lambda df, path: df.write.mode("overwrite").parquet(path),
    "xlsx": lambda df, path: put(df.sparkSession, path, workbook({"data": df})),
}


def register_writer(extension: str, writer: Callable[[DataFrame, str], None]) -> None:
    """Add or replace the writer of an extension."""
    REGISTRY[extension.lower().lstrip(".")] = writer


def supported() -> list[str]:
    return sorted({*REGISTRY, *sinks.WRITERS})


def write(df: DataFrame, path: str) -> None:
    """Write by the path's extension; unknown extensions are an error."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in REGISTRY:
        REGISTRY[kind](df, path)
    else:
        sinks.export_grid(df, path)


def write_voxler(points: DataFrame, path: str) -> None:
    """Comma-separated x, y, z (0 if there is none) and value."""
    z = F.col("z") if "z" in points.columns else F.lit(0.0).alias("z")
    sinks.write_csv(points.select("x", "y", z, "value"), path)


def write_grapher(df: DataFrame, path: str) -> None:
    sinks.write_csv(df, path, sep="\t")


def write_report(spark: SparkSession, title: str, sections: dict[str, DataFrame], path: str) -> None:
    """HTML, XLSX, DOCX or PDF by the path's extension."""
    makers = {"html": lambda: sinks.report(title, sections).encode(), "xlsx": lambda: workbook(sections), "docx": lambda: document(title, sections), "pdf": lambda: pages(title, sections)}
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in makers:
        raise ValueError(f"no report as .{kind}")
    put(spark, path, makers[kind]())


# --- well logs as a data source ----------------------------------------------------------------------------------


class WellLogs(DataSource):
    """A well log given as text, in long form: the pattern for sources of one's own.

    Option ``text`` holds the whole log, so it suits logs that fit into a plan. Logs in files are read by ``read_las``,
    which leaves the splitting of files to Spark. Register it with ``spark.dataSource.register(WellLogs)``.
    """

    @classmethod
    def name(cls) -> str:
        return "well_log"

    def schema(self) -> str:
        return "depth double, curve string, value double"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options.get("text", ""))


class _LogReader(DataSourceReader):
    def __init__(self, text: str):
        self.text = text

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition):
        import re

        names, section, missing = [], "", -999.25
        for line in map(str.strip, self.text.splitlines()):
            if line.startswith("~"):
                section = line[1:2].upper()
            elif line and not line.startswith("#"):
                head = re.match(r"([^.\s]+)\s*\.", line)
                if section == "C" and head:
                    names.append(head[1])
                elif section == "W" and head and head[1].upper() == "NULL":
                    missing = float(re.findall(r"-?\d+(?:\.\d+)?", line.split(".", 1)[1])[0])
                elif section == "A":
                    depth, *values = map(float, line.split())
                    for curve, v in zip(names[1:], values):
                        yield depth, curve, None if v == missing else v

"""Sinks: tables as CSV, catalogs, a workbook, a bundle (K1, K2, K5, K8)."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.functions import cells as C
from gridloom.operators import bookkeeping as B


def write_tables(tables: DataFrame, path: str) -> None:
    """Each table's header and rows as CSV lines under doc_id=/table_id=, written by the executors."""
    lines = F.concat(F.array(F.col("names")), F.col("rows"))
    quoted = lambda v: F.concat(F.lit('"'), F.replace(F.coalesce(v, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.array_join(F.transform(lines, lambda r: F.array_join(F.transform(r, lambda v: F.when(v.rlike('[",\n]'), quoted(v)).otherwise(F.coalesce(v, F.lit("")))), ",")), "\n")
    tables.select(*M.KEYS, text.alias("value")).write.mode("overwrite").partitionBy(*M.KEYS).text(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").option("header", True).csv(path)


def _cell(ref: str, v) -> str:
    """A text, or a pair of a text and what it is as a number (none: it stays a text)."""
    text, number = v if isinstance(v, tuple) else (v, None)
    return f'<c r="{ref}"><v>{number}</v></c>' if number else f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _sheet(rows: list[list[str]], frozen: int = 0, links: list[tuple[str, str]] = ()) -> str:
    widths = [min(45, 2 + max((len(r[k][0] if isinstance(r[k], tuple) else r[k]) for r in rows[:50] if k < len(r)), default=0)) for k in range(max(map(len, rows), default=0))]
    cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1))
    view = f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{frozen}" topLeftCell="A{frozen + 1}" state="frozen"/></sheetView></sheetViews>' if frozen else ""
    data = "".join(f'<row r="{i}">' + "".join(_cell(f"{_letters(j)}{i}", v) for j, v in enumerate(r, 1) if v and v != ("", None)) + "</row>" for i, r in enumerate(rows, 1))
    jump = "<hyperlinks>" + "".join(f'<hyperlink ref="{a}" location="\'{escape(s)}\'!A1"/>' for a, s in links) + "</hyperlinks>" if links else ""
    return f'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{view}{"<cols>" + cols + "</cols>" if cols else ""}<sheetData>{data}</sheetData>{jump}</worksheet>'


def workbook(tables: DataFrame, doc_id: int) -> bytes:
    """One document's kept tables: a contents sheet with links, then a sheet for each table that has rows.

    One document's tables, which a workbook must hold in memory anyway, come to the driver.
    """
    named = B.sheet_names(tables.filter((F.col("doc_id") == doc_id) & (F.size("rows") > 0)))
    as_number = lambda v: M.bind(F.struct(v.alias("v"), B.written_number(v).alias("w")), lambda s: F.struct(F.coalesce(s["v"], F.lit("")).alias("text"), F.when(s["w"]["kind"] != "text", C.ascii_digits(s["v"])).alias("number")))
    cells = F.transform("rows", lambda r: F.transform(r, as_number)).alias("rows")
    found = named.select("table_id", "name", "pages", "names", cells, "sheet").orderBy("table_id").collect()
    contents = [["#", "Table Name", "PDF Page", "Rows", "Cols", "Sheet"]] + [[str(k), t.name or "", str(t.pages[0]), str(len(t.rows)), str(len(t.names)), t.sheet] for k, t in enumerate(found, 1)]
    if not found:
        contents = [["No tables extracted."]]
    sheets = [("Contents", _sheet(contents, links=[(f"F{k}", t.sheet) for k, t in enumerate(found, 2)]))]
    sheets += [(t.sheet, _sheet([[t.name or ""], [], list(t.names), *([tuple(v) for v in r] for r in t.rows)], 3)) for t in found]
    out = io.BytesIO()
    ns = "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1)) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="s{k}"/>' for k, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{ns}/package/2006/relationships">' + "".join(f'<Relationship Id="s{k}" Type="{ns}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, (_, xml) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", xml)
    return out.getvalue()


def bundle(tables: DataFrame, doc_id: int) -> bytes:
    """A zip of one document's tables as CSV, its catalog and its workbook."""
    import csv

    def lines(rows) -> str:
        text = io.StringIO()
        csv.writer(text).writerows(rows)
        return text.getvalue()

    own = tables.filter(F.col("doc_id") == doc_id)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for t in own.select("table_id", "names", "rows").orderBy("table_id").collect():
            z.writestr(f"table_{t.table_id}.csv", lines([t.names, *t.rows]))
        entries = B.catalog(own).drop("doc_id").orderBy("table_id")
        z.writestr("catalog.csv", lines([entries.columns, *entries.collect()]))
        z.writestr("tables.xlsx", workbook(tables, doc_id))
    return out.getvalue()

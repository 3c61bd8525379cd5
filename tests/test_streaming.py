"""Grids that arrive in files go through the chain once each."""

from gridloom.sources import readers as RD
from gridloom.streaming import ingest


def test_ingest(spark, tmp_path):
    rows = [["Nation", "Customers", "Balance"], ["Algeria", "1,200", "12,345"], ["Kenya", "900", "(3,210)"], ["Peru", "950", "3,555"]]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for doc in (1, 2):
        spark.createDataFrame([(doc, 1, 4, "Table 3.2 Customers", k, r) for k, r in enumerate(rows)], ingest.GRID).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(ingest.grid_stream(spark, source), out, state).awaitTermination()
    got = spark.read.parquet(f"{out}/tables").orderBy("doc_id").collect()
    assert [(r["doc_id"], len(r["rows"])) for r in got] == [(1, 3), (2, 3)]
    assert got[0]["rows"] == got[1]["rows"]


def test_scorecards(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"doc": "a", "tables": 3}')
    (tmp_path / "b.json").write_text('{"doc": "b", "error": "broken"}')
    (tmp_path / "_all.json").write_text('{"doc": "all", "tables": 9}')
    assert [r["doc"] for r in RD.read_scorecards(spark, str(tmp_path)).collect()] == ["a"]


def test_files_with_other_contents_are_rows(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "y.pdf").write_bytes(b"<!DOCTYPE html><html>")
    got = {r["path"][-5:]: r["status"] for r in RD.read_files(spark, str(tmp_path)).collect()}
    assert got == {"x.pdf": "ok", "y.pdf": "invalid_source:bot_redirect"}

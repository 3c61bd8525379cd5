"""Small grids with known answers, and properties that must hold for any grid."""

import io
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.functions import cells as C
from gridloom.functions import text as X
from gridloom.operators import geometry as G
from gridloom.operators import headers as H
from gridloom.operators import naming as N
from gridloom.operators import quality as Q
from gridloom.operators import rows as R
from gridloom.operators import stitch as ST
from gridloom.operators import structure as S
from gridloom.operators import validate as V
from gridloom.plans import pipeline as P
from gridloom.sources import readers as RD
from gridloom.sources import sinks

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def table(spark, rows, **more):
    values = [(1, 1, rows, *more.values())]
    ddl = "doc_id long, table_id long, rows array<array<string>>" + "".join(f", {k} {'array<string>' if isinstance(v, list) else 'string' if isinstance(v, str) else 'int'}" for k, v in more.items())
    return spark.createDataFrame(values, ddl)


def value(spark, expr, **columns):
    ddl = ", ".join(f"{k} {'array<array<string>>' if v and isinstance(v, list) and isinstance(v[0], list) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], ddl).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,number", [("45,544", 45544.0), ("3348245*", 3348245.0), ("(7.5)", -7.5), ("12.3%", 12.3), ("−5", -5.0), ("–3", -3.0), ("-", None), ("n.a.", None), ("abc", None), ("(7.5", 7.5), (None, None), ("neg", None), ("", None)])
def test_to_number(spark, text, number):
    assert value(spark, C.to_number(F.col("v")), v=text) == number


def test_null_cells_are_missing(spark):
    assert value(spark, C.missing(F.col("v")), v=None) is True
    assert value(spark, R.normal_cell(F.col("v")), v=None) == ""


@QUIET
@given(st.lists(st.sampled_from(["a", "a_2", "b", "b_2", "col"]), min_size=1, max_size=7))
def test_deduped_names_are_unique(spark, names):
    got = value(spark, N.dedupe_names(F.col("n")), n=names)
    assert len(set(got)) == len(got) == len(names)


@QUIET
@given(st.lists(st.lists(st.sampled_from(["", "x", "4", "(5)"]), min_size=3, max_size=3), min_size=1, max_size=9))
def test_continuation_matches_a_plain_loop(spark, rows):
    out = []
    for r in rows:
        values = [c for c in r if c]
        if not r[0] and values and all(c in ("4", "(5)") for c in values) and out and out[-1][0]:
            out[-1] = [" ".join(x for x in pair if x) for pair in zip(out[-1], r)]
        else:
            out.append(list(r))
    assert value(spark, S.merge_continued(F.col("r")), r=rows) == out


@QUIET
@given(st.lists(st.sampled_from([["Women", "", ""], ["41. Mothers", "", ""], ["and more", "", ""], ["", "8.5", "7"], ["Full", "1", "2"]]), min_size=1, max_size=9))
def test_wrapped_rows_keep_their_numbers(spark, rows):
    got = value(spark, S.reassemble_wrapped(F.col("r")), r=rows)
    assert [r[1:] for r in got if r[1]] == [r[1:] for r in rows if r[1]]
    assert " ".join(r[0] for r in got if r[0]).split() and len(got) <= len(rows) if any(r[0] for r in rows) else True


def test_sections(spark):
    rows = [["Marriage", "", ""], ["Women 20-24", "11.4", "14.7"], ["Rate", "1.6", "2.1"], ["Mortality", "", ""], ["Neonatal", "18.6", "24.5"], ["Note: x", "", ""]]
    got = S.lift_sections(table(spark, rows, names=["label", "u", "r"])).first()
    assert got["names"] == ["category", "label", "u", "r"]
    assert got["rows"] == [["Marriage", "Women 20-24", "11.4", "14.7"], ["Marriage", "Rate", "1.6", "2.1"], ["Mortality", "Neonatal", "18.6", "24.5"]]
    one = [["Marriage", "", ""], ["Women", "1", "2"]]
    assert S.lift_sections(table(spark, one)).first()["rows"] == one


def test_stacked_title_with_a_split_capital(spark):
    rows = [["Total", "5"], ["A", "nnexure 3.2: Top"], ["State", "n"], ["Goa", "1"], ["Assam", "2"]]
    got = S.split_stacked(table(spark, rows)).orderBy("part").collect()
    assert [(r["title"], len(r["rows"])) for r in got] == [(None, 1), ("Annexure 3.2: Top", 3)]


def test_archetypes_and_reference_headers(spark):
    codes = [["NCO 2015", ""], *[[f"111{k}.0100", f"Manager general {k}"] for k in range(6)]]
    assert value(spark, Q.archetype(F.col("r"))["archetype"], r=codes) == "reference"
    assert value(spark, H.header_rows(F.col("r")), r=codes) == 1
    numbers = [["State", "n"], *[["Goa", str(k)] for k in range(6)]]
    assert value(spark, Q.archetype(F.col("r"))["archetype"], r=numbers) == "statistical"


def test_soup(spark):
    for token, soup in {"ftyk": True, "eqjSuk": True, "Total": False, "Non-Tax": False, "banks": False, "MinistriesDepartments": False, "ys[ks": True}.items():
        assert value(spark, X.looks_soup(F.col("t")), t=token) is soup, token
    assert value(spark, X.soup_to_unicode(F.col("t")), t="ftyk") == "जिला"
    assert value(spark, X.transliterate(F.col("t")), t="२०२४ abc") == "2024 abc"


def test_reasons(spark):
    names = F.array(F.lit("name"), F.lit("total"))
    reason = lambda rows: value(spark, V.reason(F.col("r"), names), r=rows)
    assert reason([["Goa", "1"], ["Assam", "2"]]) == "ok"
    assert reason([["1", "2"], ["4", "5"]]) == "ok"
    assert reason([["1", "2"]]) == "index_legend_only"
    assert reason([["Goa", "1 2 3 4"], ["Assam", "5 6 7 8"]]) == "merged_rows"
    assert value(spark, V.reason(F.col("r"), F.array(F.lit("x"))), r=[["a"]]) == "too_few_columns"


def test_entity_pages_are_not_stitched(spark):
    names = ["state", "urban_rate", "rural_rate"]
    items = spark.createDataFrame([(1, 1, 1, "Assam Key Indicators", 8, names), (1, 2, 2, "Assam Key Indicators", 8, names), (1, 3, 3, "Bihar Key Indicators", 8, names), (1, 4, 9, None, 2, names)], ST.ITEMS)
    got = ST.stitched_items(items).orderBy("group_id").collect()
    assert [(r["name"], r["pages"], r["n_rows"]) for r in got] == [("Assam Key Indicators", [1, 2], 16), ("Bihar Key Indicators", [3], 8), (None, [9], 2)]


def test_words_become_a_grid(spark):
    words = [(1, 1, 10.0, 60.0, 10.0 * k, f"Item {k}") for k in range(4)] + [(1, 1, x - 20.0, x, 10.0 * k + 1, str(100 + k)) for k in range(4) for x in (200.0, 300.0)]
    df = spark.createDataFrame(words, "doc_id long, page int, x0 double, x1 double, top double, text string")
    got = [r["cells"] for r in G.grid_from_words(df).orderBy("row_idx").collect()]
    assert got == [[f"Item {k}", str(100 + k), str(100 + k)] for k in range(4)]
    fused = spark.createDataFrame([(1, 1, 0.0, 60.0, 1.0, "(1.5)(222)")], df.schema)
    assert [r["text"] for r in G.split_fused(fused).orderBy("x0").collect()] == ["(1.5)", "(222)"]


def test_chain_and_sinks(spark, tmp_path):
    rows = [["Nation", "Customers", "Balance"], ["Algeria", "1,200", "12,345"], ["Kenya", "900", "(3,210)"], ["Peru", "950", "3,555"]]
    grid = spark.createDataFrame([(1, 1, 4, "Table 3.2 Customers", k, r) for k, r in enumerate(rows)], "doc_id long, table_id long, page int, caption string, row_idx int, cells array<string>")
    made = P.run(M.pack(grid, "page", "caption"))
    entry = made["catalog"].first()
    assert (entry["table_name"], entry["rows"], entry["column_names"]) == ("Table 3.2 Customers", 3, "nation|customers|balance")
    assert sorted(r["num"] for r in made["cells"].filter("num is not null").collect()) == [-3210.0, 900.0, 950.0, 1200.0, 3555.0, 12345.0]
    assert made["quarantine"].count() == 0
    with zipfile.ZipFile(io.BytesIO(sinks.bundle(made["tables"], 1))) as z:
        assert {"table_1.csv", "catalog.csv", "tables.xlsx"} == set(z.namelist())
    sinks.write_tables(made["tables"], str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).count() == 4


def test_sources(spark, tmp_path):
    assert RD.page_scope(None) is None and RD.page_scope("3,7-9") == [3, 7, 8, 9] and RD.page_scope(4) == [4]
    (tmp_path / "table_7.csv").write_text('a,b\n"x, y",2\n')
    got = RD.read_csv_grid(spark, str(tmp_path / "*.csv")).orderBy("row_idx").collect()
    assert [(r["table_id"], r["cells"]) for r in got] == [(7, ["a", "b"]), (7, ["x, y", "2"])]
    page = spark.createDataFrame([(1, "<table><tr><th>A</th><td> b <i>c</i></td></tr></table>")], "page_id long, html string")
    assert RD.html_tables(page).first()["cells"] == ["A", "b c"]


def test_packing_is_the_only_shuffle(spark):
    grid = spark.createDataFrame([(1, 1, 0, ["a", "b"])], "doc_id long, table_id long, row_idx int, cells array<string>")
    t = M.pack(grid).withColumn("rows", S.merge_continued(R.clean_rows(F.col("rows"))))
    assert t.select(Q.score(F.col("rows")))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_survey_bands(spark):
    """Names of random survey bands, worked out cell by cell."""
    import random
    import re

    from gridloom.operators import headers as H

    rng, made = random.Random(5), []
    for k in range(250):
        width = rng.randrange(3, 8)
        waves = ["", *(rng.choice(["", "", "NFHS-6", "nfhs 5", "Other"]) for _ in range(width - 1))]
        labels = ["Indicators", *(rng.choice(["", "Urban", "Rural", "Total", "Urban Rural", "Total (%)"]) for _ in range(width - 1))]
        made.append((k, [waves, labels, [f"{k}. x", *("7" for _ in range(width - 1))]]))

    def names(waves, labels):
        labels = [v.lower() for v in labels]
        apart, merged = "urban" in labels and "rural" in labels, ["urban" in v and "rural" in v for v in labels]
        found = [re.search("nfhs[ -]*([0-9])", w.lower()) for w in waves]
        if not any(found) or not (apart or any(merged)):
            return None
        first = next(m[1] for m in found if m)
        group = ["nfhs" + next((m[1] for m in reversed(found[: c + 1]) if m), first) for c in range(len(waves))]
        out, seen = ["indicator"], {"indicator": 0}
        for c in range(1, len(waves)):
            if c == 2 and merged[1]:
                own = "rural"
            elif merged[c]:
                own = "urban" if c == 1 else "rural"
                if c > 1 and re.fullmatch("col_[0-9]+", out[-1]):
                    out[-1] = f"{group[c - 1]}_urban"
            else:
                own = next((w for w in ("urban", "rural", "total") if w in labels[c]), None)
            name = f"{group[c]}_{own}" if own else f"col_{c}"
            seen[name] = seen.get(name, -1) + 1
            out.append(f"{name}_{seen[name]}" if seen[name] else name)
        return out

    df = spark.createDataFrame(made, "k int, rows array<array<string>>")
    got = {r["k"]: r["n"] for r in df.select("k", H.survey_names(F.col("rows"), F.lit(2)).alias("n")).collect()}
    want = {k: names(rows[0], rows[1]) for k, rows in made}
    assert got == want and sum(v is not None for v in want.values()) > 100


def test_panel_boundaries(spark):
    """The boundary of random grids, worked out row by row."""
    import random

    from gridloom.operators import structure as S

    rng, grids = random.Random(7), []
    for k in range(120):
        width, cut, n = rng.randrange(3, 9), rng.randrange(1, 7), rng.randrange(6, 24)
        side = lambda i, r: (i < cut) == r  # noqa: E731,B023
        grids.append((k, [[(rng.choice(["7", "1,5", "x", "nan", ""]) if rng.random() < 0.9 else "") if side(i, j % 2 == 0) or rng.random() < 0.1 else "" for i in range(width)] for j in range(n)]))

    def boundary(rows):
        full = lambda v: v not in ("", "nan")
        number = lambda v: v in ("7", "1,5")
        best = None
        for k in range(2, len(rows[0]) - 1):
            sides = [[(any(map(t, r[:k])), any(map(t, r[k:]))) for r in rows] for t in (full, number)]
            n, lo, ro = (sum(map(f, sides[0])) for f in (any, lambda s: s[0] and not s[1], lambda s: s[1] and not s[0]))
            ln, rn = (sum(s[i] for s in sides[1]) for i in (0, 1))
            if n >= 8 and min(lo, ro) >= 0.22 * n and lo + ro >= 0.55 * n and ln >= 5 and rn >= 5 and (best is None or min(lo, ro) / n > best[0]):
                best = (min(lo, ro) / n, k)
        return best and best[1]

    df = spark.createDataFrame(grids, "k int, rows array<array<string>>")
    got = {r["k"]: r["b"] for r in df.select("k", S.panel_boundary(F.col("rows")).alias("b")).collect()}
    want = {k: boundary(rows) for k, rows in grids}
    assert got == want and sum(v is not None for v in want.values()) > 10


def test_extraction_feeds_the_chain(spark):
    """Attempts to catalog: the best reader wins, what was tried stays on record, headers come back from the page's words."""
    from gridloom.plans import extraction as EX
    from gridloom.plans import pipeline as PL

    data = [[f"{k}", f"Area {k}", f"{k * 7}", f"{k}.5"] for k in range(1, 9)]
    attempt = lambda doc, table, strategy, k, rows: (doc, 1, table, strategy, k, "Table 1.1 Areas by size", rows, 100.0, [100.0 + 10 * i for i in range(len(rows) + 1)], [(0.0, 20.0), (20.0, 60.0), (60.0, 80.0), (80.0, 99.0)])
    rows = [attempt(1, 1, "lattice", 0, data), attempt(1, 1, "stream", 1, [[r[0], r[1], "", ""] for r in data]), attempt(2, 1, "lattice", 0, [["one\ntwo\nthree", "a\nb\nc"], ["d\ne\nf", "g"]]), attempt(2, 1, "stream", 1, [["x", ""], ["", "y"]])]
    ddl = "doc_id long, page int, table_id long, strategy string, attempt int, caption string, rows array<array<string>>, top double, row_tops array<double>, columns array<struct<lo:double,hi:double>>"
    words = [(1, 1, 1.0, 10.0, 92.0, "Rank"), (1, 1, 25.0, 50.0, 92.0, "State"), (1, 1, 62.0, 75.0, 92.0, "Output"), (1, 1, 82.0, 95.0, 92.0, "Share")]
    t = EX.extracted(spark.createDataFrame(rows, ddl), spark.createDataFrame(words, "doc_id long, page int, x0 double, x1 double, top double, text string"))
    got = {r["doc_id"]: r for r in t.collect()}
    assert got[1]["strategy"] == "lattice" and got[1]["rows"][0] == ["Rank", "State", "Output", "Share"] and got[1]["strategies_tried"].count(";") == 1
    assert got[2]["strategy"] == "stream" and got[2]["low_quality"] and got[2]["strategies_tried"].startswith("stream:")
    out = PL.run(t)
    assert [r["names"] for r in out["tables"].collect()] == [["s_no", "state", "output", "share"]]  # 1, 2, 3, ... are serial numbers
    assert [(r["doc_id"], r["strategies_tried"]) for r in out["quarantine"].collect()] == [(2, got[2]["strategies_tried"])]

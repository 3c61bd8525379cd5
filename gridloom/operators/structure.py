"""Structure of packed tables: sections, wrapped and continued rows, panels, stacked tables, ghost columns.

Order-dependent steps write one letter per row and read the runs with regular expressions, so a
sequential walk becomes an expression on one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.functions import cells as C
from gridloom.operators import rows as R

# Patterns of stacked titles and of entries printed one after another in a cell.
STACK_TITLE = r"(?i)^(table|tabel|statement|annexure|appendix)\s*[\(\-:.]?\s*\p{Nd}"
ENTRY = r"\p{Nd}+(?:\.\p{Nd}+)?\s+[A-Z][A-Za-z\s()&/,.-]{3,}\p{Nd}+(?:\.\p{Nd}+)?"
ENTRY_BOUNDARY = r"(?<=\p{Nd})\s+(?=\p{Nd}+[\s.]\s*[A-Z])"
SERIAL_FIRST = r"^(\p{Nd}+)\s+([A-Z][A-Za-z\s()&/,.-]+?)\s+(\p{Nd}+(?:\.\p{Nd}+)?)$"
VALUE_FIRST = r"^(\p{Nd}+(?:\.\p{Nd}+)?)\s+([A-Z][A-Za-z\s()&/,.-]+?)\s+(\p{Nd}+)$"


def letters(rows: Column, kind) -> Column:
    return F.array_join(F.transform(rows, kind), "")


# -- W2 sections ------------------------------------------------------------------------------------


def section_letters(rows: Column) -> Column:
    """L: a label alone, D: values, B: neither."""

    def kind(r: Column) -> Column:
        rest = R.tail_cells(r)
        return F.when(C.populated(F.get(r, F.lit(0))) & F.forall(rest, C.missing), "L").when(F.exists(rest, C.populated), "D").otherwise("B")

    return letters(rows, kind)


def lift_sections(tables: DataFrame) -> DataFrame:
    """Banner rows become a first column on the data rows below them, where two of them head data.

    Adds ``category`` to ``names`` when the column is there; unsectioned tables stay as they are.
    """
    k = tables.withColumn("_k", section_letters(F.col("rows")))
    # S: a banner that data follows before the next banner
    flagged = F.transform(M.indices(F.size("rows")), lambda i: F.when((F.substring(F.col("_k"), i + 1, F.lit(1)) == "L") & F.substring(F.col("_k"), i + 2, F.length("_k")).rlike("^B*D"), "S").otherwise(F.substring(F.col("_k"), i + 1, F.lit(1))))
    k = k.withColumn("_s", F.array_join(flagged, ""))
    before = lambda i: F.substring(F.col("_s"), F.lit(1), i)
    at = lambda i: F.length(F.regexp_extract(before(i), r"^(.*)S", 1))  # noqa: E731  index of the last section before i
    made = F.transform("rows", lambda r, i: F.struct(F.substring(F.col("_s"), i + 1, F.lit(1)).alias("kind"), F.when((F.substring(F.col("_s"), i + 1, F.lit(1)) == "D") & before(i).contains("S"), C.strip(F.get(F.get(F.col("rows"), at(i)), F.lit(0)))).otherwise("").alias("category"), r.alias("r")))
    k = k.withColumn("_m", F.filter(made, lambda x: ~x["kind"].isin("L", "S")))
    fires = (F.length(F.regexp_replace("_s", "[^S]", "")) >= 2) & (M.count(F.col("_m"), lambda x: x["category"] != "") >= 2) & (M.width(F.col("rows")) >= 2)
    k = k.withColumn("_f", fires)
    if "names" in tables.columns:
        low = F.transform("names", F.lower)
        free = F.filter(F.array(F.lit("category"), F.lit("section"), F.lit("section_category"), *(F.lit(f"category_{n}") for n in range(2, 9))), lambda n: ~F.array_contains(low, n))
        k = k.withColumn("names", F.when(F.col("_f"), F.concat(F.array(F.get(free, F.lit(0))), F.col("names"))).otherwise(F.col("names")))
    lifted = F.transform("_m", lambda x: F.concat(F.array(x["category"]), x["r"]))
    return k.withColumn("rows", F.when(F.col("_f"), lifted).otherwise(F.col("rows"))).drop("_k", "_s", "_m", "_f")


# -- W3 continued values ----------------------------------------------------------------------------


def merge_continued(rows: Column) -> Column:
    """Rows of numbers without a label fold into the labelled row above: blanks fill, others append."""

    def kind(r: Column) -> Column:
        v = F.filter(F.transform(r, C.strip), lambda x: x != "")
        label = C.strip(F.get(r, F.lit(0)))
        return F.when((label == "") & (F.size(v) > 0) & F.forall(v, lambda x: x.rlike(C.NUMBER)), "C").when(label != "", "H").otherwise("U")

    def merged(rs: Column, k: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            here, prefix = F.substring(k, i + 1, F.lit(1)), F.substring(k, F.lit(1), i)
            followers = F.slice(rs, i + 2, F.length(F.regexp_extract(F.substring(k, i + 2, F.length(k)), "^(C*)", 1)))
            joined = F.transform(r, lambda v, j: F.array_join(F.filter(F.concat(F.array(C.strip(v)), F.transform(followers, lambda f: C.strip(F.get(f, j)))), lambda x: x != ""), " "))
            folded = F.when((here == "H") & (F.size(followers) > 0), joined).otherwise(r)
            return F.struct((~((here == "C") & prefix.rlike("HC*$"))).alias("keep"), folded.alias("r"))

        return F.transform(F.filter(F.transform(rs, one), lambda x: x["keep"]), lambda x: x["r"])

    return M.bind(F.struct(rows.alias("rows"), letters(rows, kind).alias("k")), lambda s: merged(s["rows"], s["k"]))


# -- W4 wrapped rows --------------------------------------------------------------------------------


def reassemble_wrapped(rows: Column) -> Column:
    """Numbers on a row of their own take the label lines around them: back to a numbered start, on to the next one or a section title."""

    def kind(r: Column) -> Column:
        text = C.strip(F.get(r, F.lit(0)))
        label = F.when(text.rlike(r"^\p{Nd}+\s*\."), "B").when(R.is_section_title(text), "S").otherwise("T")
        return F.when(R.is_numeric_only(r), "N").when(R.is_label_only(r), label).otherwise("O")

    def runs(k: Column) -> Column:
        parts = F.regexp_extract_all(k, F.lit("(B?T*NT*|.)"), F.lit(1))
        return F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, q: a + F.length(q)).alias("at")))

    def joined(rs: Column, run: Column) -> Column:
        own = F.slice(rs, run["at"] + 1, F.length(run["p"]))
        numbers = F.get(own, F.instr(run["p"], "N") - 1)
        label = F.array_join(F.filter(F.transform(own, lambda r: C.strip(F.get(r, F.lit(0)))), lambda x: x != ""), " ")
        whole = F.transform(numbers, lambda v, j: F.when((j == 0) & (label != ""), label).otherwise(v))
        return F.when(run["p"].contains("N"), whole).otherwise(F.get(own, F.lit(0)))

    made = M.bind(F.struct(rows.alias("rows"), letters(rows, kind).alias("k")), lambda s: F.transform(runs(s["k"]), lambda run: joined(s["rows"], run)))
    return F.when(M.width(rows) >= 2, made).otherwise(rows)


# -- R6 two panels side by side ---------------------------------------------------------------------


def panel_boundary(rows: Column, least_rows: int = 8, least_share: float = 0.22, least_numbers: int = 5) -> Column:
    """The column where a right panel begins: many rows fill one side only, both sides hold numbers; null for none."""
    full = lambda v: ~F.lower(C.strip(v)).isin("", "nan", "none")

    def ends(r: Column) -> Column:
        """Where a row's filled cells and its numbers begin and end; that decides every boundary."""
        at = lambda test: F.filter(F.transform(r, lambda v, i: F.when(test(v), i)), lambda i: i.isNotNull())
        out = lambda filled, number: F.struct(F.array_min(filled).alias("f"), F.array_max(filled).alias("l"), F.array_min(number).alias("fn"), F.array_max(number).alias("ln"))
        return M.bind(F.struct(at(full).alias("a"), at(C.is_number).alias("b")), lambda x: out(x["a"], x["b"]))

    def rate(rows_: Column, k: Column) -> Column:
        has = lambda test: M.count(rows_, lambda x: F.coalesce(test(x), F.lit(False)))
        counts = F.struct(has(lambda x: x["f"].isNotNull()).alias("n"), has(lambda x: x["l"] < k).alias("lo"), has(lambda x: x["f"] >= k).alias("ro"), has(lambda x: x["fn"] < k).alias("ln"), has(lambda x: x["ln"] >= k).alias("rn"))

        def rated(c: Column) -> Column:
            n, lo, ro = c["n"], c["lo"], c["ro"]
            ok = (n >= least_rows) & (lo >= least_share * n) & (ro >= least_share * n) & (lo + ro >= 0.55 * n) & (c["ln"] >= least_numbers) & (c["rn"] >= least_numbers)
            return F.when(ok, F.struct((F.least(lo, ro) / n).alias("s"), (-k).alias("k")))

        return M.bind(counts, rated)

    w = M.width(rows)
    options = F.when(w >= 4, F.sequence(F.lit(2), w - 2)).otherwise(F.array().cast("array<int>"))
    return -M.bind(F.transform(rows, ends), lambda e: F.array_max(F.transform(options, lambda k: rate(e, k))))["k"]


def split_side_by_side(tables: DataFrame) -> DataFrame:
    """Two independent panels become two tables (``part`` 0 and 1), each with its own filled rows; others keep part 0."""
    full = lambda r: F.exists(r, lambda v: ~F.lower(C.strip(v)).isin("", "nan", "none"))
    t = tables.withColumn("_k", panel_boundary(F.col("rows")))
    left = F.filter(F.transform("rows", lambda r: F.slice(r, F.lit(1), F.col("_k"))), full)
    right = F.filter(F.transform("rows", lambda r: F.slice(r, F.col("_k") + 1, F.size(r))), full)
    parts = F.when(F.col("_k").isNotNull() & (F.size(left) >= 2) & (F.size(right) >= 2), F.array(left, right)).otherwise(F.array(F.col("rows")))
    other = [c for c in tables.columns if c != "rows"]
    return t.withColumn("_p", parts).select(*other, F.posexplode("_p").alias("part", "rows"))


# -- R7 tables stacked in one grid ------------------------------------------------------------------


def stack_title(r: Column) -> Column:
    """The title that a row's one to three cells make up, a split first capital rejoined; null for none."""
    v = R.non_empty(r)
    text = F.regexp_replace(F.regexp_replace(F.array_join(v, " "), r"\s+", " "), r"^([A-Za-z]) (?=[a-z]{2})", "$1")
    return F.when(F.size(v).between(1, 3) & text.rlike(STACK_TITLE), F.substring(text, 1, 300))


def split_stacked(tables: DataFrame) -> DataFrame:
    """Interior title rows start new tables (``part``, ``title``): the first part may have one row, later ones need two."""
    t = tables.withColumn("_t", F.transform("rows", lambda r, i: F.when(i > 0, stack_title(r))))
    cuts = F.filter(F.transform("_t", lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    t = t.withColumn("_c", F.concat(F.array(F.lit(-1)), cuts, F.array(F.size("rows"))))
    spans = F.transform(M.indices(F.size("_c") - 1), lambda i: F.struct(F.get("_c", i).alias("cut"), F.slice("rows", F.get("_c", i) + 2, F.get("_c", i + 1) - F.get("_c", i) - 1).alias("rows"), F.get("_t", F.greatest(F.get("_c", i), F.lit(0))).alias("title")))
    parts = F.filter(spans, lambda s: F.size(s["rows"]) >= F.when(s["cut"] < 0, 1).otherwise(2))
    fires = (F.size("rows") >= 5) & (F.size("_c") > 2) & (F.size(parts) > 0) & ~((F.size(parts) == 1) & F.get(parts, F.lit(0))["title"].isNull())
    whole = F.array(F.struct(F.lit(-1).alias("cut"), F.col("rows"), F.lit(None).cast("string").alias("title")))
    other = [c for c in tables.columns if c != "rows"]
    return t.withColumn("_p", F.when(fires, parts).otherwise(whole)).select(*other, F.posexplode("_p").alias("part", "_s")).select(*other, "part", F.col("_s.title").alias("title"), F.col("_s.rows").alias("rows"))


# -- R8 entries printed one after another in a cell -------------------------------------------------


def panel_entries(v: Column) -> Column:
    """The entries of a cell that holds at least three; else empty."""
    text = C.strip(v)
    parts = F.filter(F.transform(F.split(text, ENTRY_BOUNDARY), C.strip), lambda p: p != "")
    fires = (F.length(text) >= 20) & (F.regexp_count(text, F.lit(ENTRY)) >= 3) & (F.size(F.split(text, ENTRY_BOUNDARY)) >= 3)
    return F.when(fires, parts).otherwise(F.array().cast("array<string>"))


def parse_entry(e: Column) -> Column:
    """Serial, name and value of an entry, whichever of serial and value comes first; else the text as name."""
    pick = lambda p, g: C.strip(F.regexp_extract(e, p, g))
    return (
        F.when(e.rlike(SERIAL_FIRST), F.array(pick(SERIAL_FIRST, 1), pick(SERIAL_FIRST, 2), pick(SERIAL_FIRST, 3)))
        .when(e.rlike(VALUE_FIRST), F.array(pick(VALUE_FIRST, 3), pick(VALUE_FIRST, 2), pick(VALUE_FIRST, 1)))
        .otherwise(F.array(F.lit(""), e, F.lit("")))
    )


def split_panels(tables: DataFrame) -> DataFrame:
    """Tables with such cells become one row per entry, by serial, with three columns; ``names`` come from the first row."""
    t = tables.withColumn("_e", F.flatten(F.transform(M.flat(F.col("rows")), panel_entries)))
    keyed = F.transform("_e", lambda e, i: F.struct(F.coalesce(F.get(parse_entry(e), F.lit(0)).try_cast("int"), F.lit(9999)).alias("key"), i.alias("i"), parse_entry(e).alias("r")))
    made = F.transform(F.array_sort(keyed), lambda x: x["r"])
    heads = R.non_empty(F.get("rows", F.lit(0)))
    heads = F.filter(heads, lambda h: F.lower(h) != "none")
    distinct = F.filter(F.transform(heads, lambda h, i: F.when(F.array_position(F.transform(heads, F.lower), F.lower(h)) == i + 1, h)), lambda h: h.isNotNull())
    names = F.when(F.size(distinct) >= 3, F.slice(distinct, 1, 3)).when(F.size(distinct) == 2, F.concat(F.array(F.lit("s_no")), distinct)).otherwise(F.array(F.lit("s_no"), F.lit("name"), F.lit("value")))
    fires = F.size("_e") > 0
    old = F.col("names") if "names" in tables.columns else F.lit(None).cast("array<string>")
    return t.withColumn("names", F.when(fires, names).otherwise(old)).withColumn("rows", F.when(fires, made).otherwise(F.col("rows"))).drop("_e")


# -- R12 ghost columns ------------------------------------------------------------------------------


def ghost_free(rows: Column, names: Column) -> Column:
    """Indices of the columns that stay: not all blank, and nameless ones filled in a fifth of the rows (of more than two columns, if two stay)."""
    keep = F.filter(M.indices(M.width(rows)), lambda i: ghost_keeps(M.column(rows, i), F.get(names, i)))
    return F.when((M.width(rows) > 2) & (F.size(keep) >= 2), keep).otherwise(M.indices(M.width(rows)))


def ghost_keeps(v: Column, name: Column) -> Column:
    blank = F.forall(v, lambda x: C.strip(x) == "")
    return ~blank & (~name.rlike(r"^col(_[0-9]+)?$") | (M.share(v, C.populated) >= 0.2))


def take_columns(tables: DataFrame, keep: Column) -> DataFrame:
    """Only the columns of ``keep``, in its order, in rows and names."""
    t = tables.withColumn("_i", keep)
    t = t.withColumn("rows", F.transform("rows", lambda r: F.transform("_i", lambda i: F.get(r, i))))
    return t.withColumn("names", F.transform("_i", lambda i: F.get("names", i))).drop("_i")


def drop_ghosts(tables: DataFrame) -> DataFrame:
    return take_columns(tables, ghost_free(F.col("rows"), F.col("names")))


def lead_columns(names: Column, *first: str) -> Column:
    """Column order with the named columns first."""
    own = M.indices(F.size(names))
    lead = F.array(*(F.array_position(names, n).cast("int") - 1 for n in first))
    lead = F.filter(lead, lambda i: i >= 0)
    return F.concat(lead, F.filter(own, lambda i: ~F.array_contains(lead, i)))

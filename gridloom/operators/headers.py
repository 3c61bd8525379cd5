"""Header bands of packed tables: their depth, and the names they give (H1-H9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.functions import cells as C
from gridloom.functions import text as X
from gridloom.operators import naming as N
from gridloom.operators import quality as Q
from gridloom.operators import rows as R
from gridloom.operators import structure as S

# Numbering rows, table titles inside headers, ranges, months that got crushed.
INDEX_CELL = r"^\(?[0-9]{1,2}\.?\)?$"
TITLE_FRAGMENT = r"(?i)\b(table|tabel|statement|annexure|appendix)\b(\s*\(?\s*\p{Nd}+([.\-]\p{Nd}+)*\s*\)?)?"
RANGE = r"^(\p{Nd}{1,3}\s*[-–]\s*\p{Nd}{1,3}|\p{Nd}{1,3}\s*\+)$"
YEAR_SPAN = r"\b(19|20)\p{Nd}{2}\s*([-–/]\s*\p{Nd}{2,4})?\b"
MONTH_TOKEN = r"(?i)^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|jun(e)?|jul(y)?|aug(ust)?|sep(t(ember)?)?|oct(ober)?|nov(ember)?|dec(ember)?)[.'’\- ]*\p{Nd}{0,4}$"
MONTHISH = r"^(col(_[0-9]+)?|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(_(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|[0-9]{2,4}))*)$"
SURVEY_WAVE = r"nfhs[\s\-–]*([0-9])"
SURVEY_LABELS = ("urban", "rural", "total")
SURVEY_COLUMNS = ("indicator", "nfhs6_urban", "nfhs6_rural", "nfhs6_total", "nfhs5_total")
SURVEY_VALUE = r"^\(?-?[\p{Nd}*,]+(\.\p{Nd}+)?%?\)?$"
SURVEY_ARTIFACT = r"^(col_?[0-9]*|urban_rural)$"
HEADER_WORDS = tuple(
    "rural urban male female person persons age ages group groups years year status industry sector work worker workers activity education level general current weekly usual "
    "principal subsidiary labour force participation rate rates unemployment employment employed distribution percentage monthly earnings wages wage self casual regular salaried "
    "household households size religion social category expenditure class state india division code item broad each according total number all occupation quintile".split()
)


def header_rows(rows: Column) -> Column:
    """How many rows the header takes: to the last month row, a legacy mark, the first year row, the first mostly numeric row."""
    top = M.head(rows, 8)
    cells = lambda r: F.filter(R.non_empty(r), lambda v: F.lit(True))
    numbers = lambda r: M.count(cells(r), lambda v: F.regexp_replace(v, " ", "").rlike(r"^-?[\p{Nd},]+(\.\p{Nd}+)?%?$"))
    dense = lambda r, share, least: (F.size(cells(r)) > 0) & (numbers(r) >= share * F.size(cells(r))) & (numbers(r) >= least)
    years = lambda r: M.count(r, lambda v: C.strip(v).rlike(C.YEAR_CELL)) >= 2
    month = F.array_max(F.transform(top, lambda r, i: F.when(R.is_month_header(r), i)))
    mark = M.first_index(top, lambda r: F.array_join(r, " ").rlike(r"¿\p{Nd}+À"))
    year = M.first_index(top, years)
    data = F.get(F.filter(F.transform(top, lambda r, i: F.when(dense(r, 0.5, 2) & ~(years(r) & (i == year)).eqNullSafe(F.lit(True)), i)), lambda i: i.isNotNull()), F.lit(0))
    first = M.first_index(top, lambda r: dense(r, 0.3, 1))
    reference = Q.archetype(rows)["archetype"] == "reference"
    return (
        F.when(F.size(rows) == 0, 1).when(reference, Q.reference_header_rows(rows)).when(month.isNotNull(), month + 1).when(mark.isNotNull(), mark + 1)
        .when(year.isNotNull(), year + 1).when(data.isNotNull(), F.greatest(data, F.lit(1))).when(first.isNotNull(), F.greatest(first, F.lit(1))).otherwise(F.least(F.lit(2), F.size(rows)))
    )


def english(text: Column) -> Column:
    """The English words of a header cell: acronyms, capitalised words and known small ones; two anchors admit other lower-case words."""
    return M.bind(C.words(F.regexp_replace(text, r"-\s*\n\s*", "-")), _english_words)


def _english_words(ws: Column) -> Column:
    acronym = lambda b: b.rlike("^[A-Z]{2,6}$")
    anchor = lambda b: acronym(b) | (X.has_vowel(b) & (F.length(b) >= 3) & b.rlike("^([A-Z][a-z]+|[A-Z]+)$"))
    small = lambda b: F.lower(b).isin(*X.SMALL_WORDS, *HEADER_WORDS)
    two = M.count(ws, lambda w: anchor(X.bare(w))) >= 2
    fits = lambda b: (b != "") & (anchor(b) | small(b) | (two & b.rlike("^[a-z]{3,}$") & X.has_vowel(b)))
    return F.array_join(F.filter(ws, lambda w: M.bind(X.bare(w), fits)), " ")


def title_rows(rows: Column, h: Column) -> Column:
    """For each header row whether it names no column: a lone cell, debris above months, a table title, a numbering row, a spread title."""
    body = M.tail(rows, h)
    numeric = M.by_column(rows, lambda v, i: M.share(R.non_empty(M.tail(v, h)), lambda x: x.rlike(C.NUMBER)) >= 0.5)
    months = M.first_index(M.head(rows, h), R.is_month_header)

    def named(r: Column, i: Column) -> Column:
        v = R.non_empty(r)
        at = F.filter(F.transform(r, lambda x, j: F.when(C.populated(x), j)), lambda j: j.isNotNull())
        run = F.element_at(at, -1) - F.get(at, F.lit(0)) + 1 == F.size(at)
        over = M.count(at, lambda j: F.get(numeric, j))
        text = F.array_join(v, " ")
        spread = (
            F.forall(v, lambda x: C.word_count(x) <= 2) & ~text.rlike(R.SUBDIVISION) & ~text.rlike(YEAR_SPAN) & (F.size(v) >= 3) & run
            & (F.size(v) < F.size(r)) & (over < F.greatest(F.lit(2.0), F.size(at) * 0.5))
        )
        debris = months.isNotNull() & (i < months) & ~F.exists(v, lambda x: x.rlike("[A-Za-z]"))
        numbering = M.count(v, lambda x: x.rlike(INDEX_CELL)) >= F.greatest(F.lit(2.0), F.size(v) * 0.5)
        return F.when(F.size(v) <= 1, True).otherwise(debris | F.get(v, F.lit(0)).rlike(TITLE_FRAGMENT) | numbering | spread)

    return F.transform(M.head(rows, h), named) if body is not None else None


def fill_right(r: Column) -> Column:
    """Blanks take the last value to their left."""
    last = lambda i: F.element_at(F.filter(F.slice(r, F.lit(1), i + 1), lambda v: C.strip(v) != ""), -1)
    some = lambda i: F.exists(F.slice(r, F.lit(1), i + 1), lambda v: C.strip(v) != "")
    return F.transform(r, lambda v, i: F.when(some(i), F.when(C.strip(v) != "", v).otherwise(last(i))).otherwise(""))


def start_of_data(rows: Column, h: Column) -> Column:
    """The header ends earlier where data rows are found earlier, but not inside a run of year rows."""
    at = R.data_start(rows)
    years = F.transform(M.head(rows, h), lambda r, i: F.when((i >= at) & ~R.is_year_header(r), i))
    return F.when(at < h, F.coalesce(F.array_min(years), h)).otherwise(h)


def band_names(rows: Column, h: Column) -> Column:
    """A name per column from the rows of the band that name something; spanning labels reach to the right, except those of the last row (unless it has years)."""

    def named(s: Column) -> Column:
        active = F.filter(F.transform(s["band"], lambda r, i: F.when(~F.get(s["titles"], i), i)), lambda i: i.isNotNull())
        last = F.element_at(active, -1)
        fills = lambda r, i: ((i != last) | F.array_join(r, " ").rlike(YEAR_SPAN)) & (M.count(r, lambda v: C.strip(v) != "") >= 2)
        filled = F.transform(s["band"], lambda r, i: F.when(fills(r, i), fill_right(r)).otherwise(r))

        def name(c: Column) -> Column:
            values = F.filter(F.transform(active, lambda i: C.strip(F.regexp_replace(C.strip(F.get(F.get(filled, i), c)), TITLE_FRAGMENT, " "))), lambda v: v != "")
            read = F.transform(values, lambda v: F.struct(F.coalesce(F.nullif(english(v), F.lit("")), F.when(C.is_year(v), v)).alias("part"), v.rlike(RANGE).alias("range"), v.alias("v")))

            def joined(found: Column) -> Column:
                parts = F.transform(F.filter(found, lambda x: x["part"].isNotNull()), lambda x: x["part"])
                ranges = F.filter(found, lambda x: x["part"].isNull() & x["range"])
                return X.clean_header(F.array_join(F.concat(parts, F.transform(F.slice(F.reverse(ranges), 1, 1), lambda x: x["v"])), "_"))

            return F.coalesce(F.nullif(M.bind(read, joined), F.lit("")), F.concat(F.lit("col_"), c.cast("string")))

        return F.transform(M.indices(M.width(rows)), name)

    made = M.bind(F.struct(M.head(rows, h).alias("band"), title_rows(rows, h).alias("titles")), named)
    none = F.transform(M.indices(M.width(rows)), lambda c: F.concat(F.lit("col_"), c.cast("string")))
    return F.when((h > 0) & F.exists(title_rows(rows, h), lambda t: ~t), made).otherwise(none)


def reference_band_names(rows: Column, h: Column) -> Column:
    """Stacked header cells joined, nothing else."""
    join = lambda c: X.clean_header(F.array_join(F.filter(F.transform(M.head(rows, h), lambda r: C.strip(F.get(r, c))), lambda v: ~F.lower(v).isin("", "nan", "none")), "_"))
    return F.transform(M.indices(M.width(rows)), lambda c: F.when((h > 0) & (join(c) != ""), join(c)).otherwise(F.concat(F.lit("col_"), c.cast("string"))))


def sub_header_rows(rows: Column, most: int = 3) -> Column:
    """How many leading data rows are sub-headers over mostly numeric rows."""
    w = M.width(rows)
    flags = F.transform(M.head(rows, F.least(F.lit(most), F.greatest(F.size(rows) - 1, F.lit(0)))), lambda r, i: R.is_sub_header(r, w) & (Q.numeric_fraction(M.tail(rows, i + 1)) >= 0.4))
    return F.coalesce(M.first_index(flags, lambda ok: ~ok), F.size(flags))


def absorb_sub_headers(tables: DataFrame) -> DataFrame:
    """Sub-header rows go into the names above them; repeats get _1, _2 and so on."""
    t = tables.withColumn("_k", sub_header_rows(F.col("rows")))
    sub = F.transform(F.slice("rows", F.lit(1), F.col("_k")), lambda r, i: F.when(i < F.col("_k") - 1, fill_right(r)).otherwise(r))
    parts = lambda n, c: F.concat(F.when(n.rlike("^col(_[0-9]+)?$"), F.array().cast("array<string>")).otherwise(F.array(n)), R.non_empty(F.transform(F.col("_u"), lambda r: F.get(r, c))))
    t = t.withColumn("_u", sub)
    made = F.transform("names", lambda n, c: F.coalesce(F.nullif(X.clean_header(F.array_join(parts(n, c), "_")), F.lit("")), F.concat(F.lit("col_"), c.cast("string"))))
    t = t.withColumn("_n", made)
    unique = F.transform("_n", lambda n, i: M.bind(M.count(F.slice("_n", F.lit(1), i), lambda x: x == n), lambda k: F.when(k > 0, F.concat(n, F.lit("_"), k.cast("string"))).otherwise(n)))
    t = t.withColumn("names", F.when(F.col("_k") > 0, unique).otherwise(F.col("names"))).withColumn("rows", M.tail(F.col("rows"), F.col("_k")))
    return t.drop("_k", "_u", "_n")


def spread_months(names: Column, band: Column) -> Column:
    """Month labels crushed into one header cell go to the trailing nameless columns they cover."""
    tokens = lambda v: C.words(v)
    months = lambda v: F.when((F.size(tokens(v)) > 0) & F.forall(tokens(v), lambda t: t.rlike(MONTH_TOKEN)), tokens(v)).otherwise(F.array().cast("array<string>"))
    by_row = F.transform(band, lambda r: F.flatten(F.transform(r, months)))
    crushed = F.exists(band, lambda r: F.exists(r, lambda v: F.size(months(v)) >= 2))
    best = F.aggregate(by_row, F.array().cast("array<string>"), lambda a, r: F.when(F.size(r) > F.size(a), r).otherwise(a))
    run = F.length(F.regexp_extract(F.array_join(F.transform(names, lambda n: F.when(n.rlike(MONTHISH), "m").otherwise("x")), ""), "(m*)$", 1))
    at = F.size(names) - F.size(best)
    made = F.transform(names, lambda n, i: F.when(i >= at, F.substring(F.lower(F.get(best, i - at)), 1, 3)).otherwise(n))
    return F.when(crushed & (F.size(best) >= 3) & (run >= F.size(best)), made).otherwise(names)


def lead_names(tables: DataFrame) -> DataFrame:
    """A first column of serials is s_no; of two district columns the last one's cells become the second column."""
    digits = M.count(F.slice("rows", 1, 10), lambda r: C.strip(F.get(r, F.lit(0))).rlike(r"^\p{Nd}+$")) >= 5
    t = tables.withColumn("names", F.when(digits & (F.size("names") > 0), F.transform("names", lambda n, i: F.when(i == 0, "s_no").otherwise(n))).otherwise(F.col("names")))
    at = F.filter(F.transform("names", lambda n, i: F.when(F.lower(n).contains("district"), i)), lambda i: i.isNotNull())
    t = t.withColumn("_d", F.when(F.size(at) >= 2, F.element_at(at, -1)))
    moved = F.transform("rows", lambda r: F.transform(r, lambda v, i: F.when((i == 1) & (F.col("_d") > 1), F.get(r, F.col("_d"))).otherwise(v)))
    t = t.withColumn("rows", F.when(F.col("_d").isNotNull(), moved).otherwise(F.col("rows")))
    t = t.withColumn("names", F.when(F.col("_d").isNotNull(), F.transform("names", lambda n, i: F.when(i == 1, "district").otherwise(n))).otherwise(F.col("names")))
    keep = F.filter(M.indices(F.size("names")), lambda i: ~((F.col("_d") > 1) & (i == F.col("_d"))).eqNullSafe(F.lit(True)))
    return S.take_columns(t, keep).drop("_d")


def survey_names(rows: Column, h: Column) -> Column:
    """Names of a survey fact sheet's columns from its wave row and its urban / rural / total row; null for other tables.

    Five columns of numbered indicators with values go on from the page before and have the usual names.
    """
    both = lambda v: v.contains("urban") & v.contains("rural")
    wave = lambda v: F.regexp_extract(v, SURVEY_WAVE, 1)

    def of_rows(p: Column) -> Column:
        said = lambda until: F.filter(F.slice(p["waves"], F.lit(1), until), lambda w: w != "")
        group = lambda i: M.bind(said(i + 1), lambda w: F.concat(F.lit("nfhs"), F.when(F.size(w) > 0, F.element_at(w, -1)).otherwise(F.get(said(F.size(p["waves"])), F.lit(0)))))
        cell = lambda i: F.coalesce(F.get(p["labels"], i), F.lit(""))
        ahead = both(cell(F.lit(1)))  # one cell over the first two value columns

        def raw(i: Column) -> Column:
            label = F.when(ahead & (i == 1), "urban").when(ahead & (i == 2), "rural").when(both(cell(i)), "rural")
            for word in SURVEY_LABELS:
                label = label.when(cell(i).contains(word), word)
            return F.when(i == 0, "indicator").otherwise(F.coalesce(F.concat(group(i), F.lit("_"), label), F.concat(F.lit("col_"), i.cast("string"))))

        def unique(names: Column) -> Column:
            late = lambda i: (i >= 1) & both(cell(i + 1)) & ~(ahead & (i == 1))  # noqa: E731  one cell over this column and the next
            again = lambda n, i: M.count(F.slice(names, F.lit(1), i), lambda x: x == n)
            return F.transform(names, lambda n, i: F.when(n.rlike("^col_[0-9]+$") & late(i), F.concat(group(i), F.lit("_urban"))).when(again(n, i) > 0, F.concat(n, F.lit("_"), again(n, i).cast("string"))).otherwise(n))

        return M.bind(F.transform(M.indices(M.width(rows)), raw), unique)

    def of_band(band: Column) -> Column:
        waves = F.get(F.filter(band, lambda r: F.exists(r, lambda v: v.rlike(SURVEY_WAVE))), F.lit(0))
        apart, merged = F.filter(band, lambda r: F.array_contains(r, "urban") & F.array_contains(r, "rural")), F.filter(band, lambda r: F.exists(r, both))
        labels = F.when(F.size(apart) > 0, F.element_at(apart, -1)).otherwise(F.get(merged, F.lit(0)))
        return M.bind(F.struct(F.transform(waves, wave).alias("waves"), labels.alias("labels")), lambda p: F.when(p["waves"].isNotNull() & p["labels"].isNotNull(), of_rows(p)))

    data = M.tail(rows, h)
    values = R.non_empty(F.flatten(F.transform(data, lambda r: F.slice(r, 2, 4))))
    numbered = M.count(data, lambda r: C.strip(F.get(r, F.lit(0))).rlike(r"^\p{Nd}{1,3}\.")) >= 2
    goes_on = (M.width(rows) == 5) & numbered & (M.share(values, lambda v: v.rlike(SURVEY_VALUE)) >= 0.5)
    lowered = F.transform(F.slice(rows, F.lit(1), h), lambda r: F.transform(r, lambda v: F.lower(C.strip(v))))
    return F.coalesce(M.bind(lowered, of_band), F.when(goes_on, F.array(*map(F.lit, SURVEY_COLUMNS))))


def survey_columns(rows: Column, names: Column) -> Column:
    """Which columns of a survey's data stay: the first five, and later ones that are named and filled by more than a fifth."""
    filled = lambda i: M.share(M.column(rows, i), C.populated) > 0.2
    return F.filter(M.indices(F.size(names)), lambda i: (i < 5) | (filled(i) & ~F.get(names, i).rlike(SURVEY_ARTIFACT)))


def apply_headers(tables: DataFrame, keep_trailing_banner: bool = False) -> DataFrame:
    """``rows`` with a header band to data ``rows`` and ``names``; needs ``h`` (``header_rows``).

    ``keep_trailing_banner`` gives lone-cell rows at the end of the band back to the data.
    """
    t = tables.withColumn("_ref", Q.archetype(F.col("rows"))["archetype"] == "reference")
    h = F.least(F.col("h"), F.greatest(F.size("rows") - 1, F.lit(0)))
    t = t.withColumn("_survey", F.when(~F.col("_ref"), survey_names(F.col("rows"), h)))
    t = t.withColumn("_ref", F.col("_ref") | F.col("_survey").isNotNull())  # nothing below touches these
    t = t.withColumn("_h", F.when(F.col("_ref"), h).otherwise(start_of_data(F.col("rows"), h)))
    if keep_trailing_banner:
        lone = F.array_join(F.transform(F.slice("rows", F.lit(1), F.col("_h")), lambda r: F.when((F.size(R.non_empty(r)) == 1) & C.populated(F.get(r, F.lit(0))), "1").otherwise("0")), "")
        t = t.withColumn("_h", F.when(~F.col("_ref"), F.greatest(F.length(F.regexp_replace(lone, "1+$", "")), F.least(F.col("_h"), F.lit(1)))).otherwise(F.col("_h")))
    t = t.withColumn("names", F.when(F.col("_survey").isNotNull(), F.col("_survey")).when(F.col("_ref"), reference_band_names(F.col("rows"), F.col("_h"))).otherwise(band_names(F.col("rows"), F.col("_h"))))
    t = t.withColumn("_band", F.slice("rows", F.lit(1), F.col("_h"))).withColumn("rows", M.tail(F.col("rows"), F.col("_h")))
    t = t.withColumn("_rows", F.col("rows")).withColumn("_names", F.col("names"))
    t = S.drop_ghosts(absorb_sub_headers(t))
    t = lead_names(t.withColumn("names", spread_months(F.col("names"), F.col("_band"))))
    t = t.withColumn("rows", F.when(F.col("_ref"), F.col("_rows")).otherwise(F.col("rows")))
    t = t.withColumn("names", F.when(F.col("_ref"), F.col("_names")).otherwise(F.col("names")))
    keep = F.when(F.col("_survey").isNotNull(), survey_columns(F.col("rows"), F.col("names"))).otherwise(M.indices(F.size("names")))
    return S.take_columns(t, keep).drop("_ref", "_survey", "_h", "_band", "_rows", "_names")


def clean_headers(tables: DataFrame, drop_second: bool = True) -> DataFrame:
    t = tables.withColumn("_c", N.clean_names(F.col("rows"), F.col("names"), drop_second))
    t = t.withColumn("rows", F.transform("rows", lambda r: F.transform(F.col("_c.own"), lambda i: F.get(r, i))))
    return t.withColumn("names", F.col("_c.names")).drop("_c")

"""Row predicates and row or table filters on packed tables (an argument ``r`` is one row's cells)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.functions import cells as C

# Words that mark a column header, and words of a heading line.
SUBDIVISIONS = (
    "rural urban males? females? persons? transgender total combined state district zone region sector category quarterly annual monthly workers? employed "
    "employment rate number percentage industry volume value debit credit assets? liabilit(?:y|ies) deposits? receipts? disbursements? production currency banks? "
    "reserve broad narrow income expenditure index prices? average weighted nominal effective balance payments? trade gross net fiscal capital revenue sanctioned "
    "outstanding circulation quantity turnover amount exports? imports? advances? borrowings? investments? securities? loans? interest supply demand inflation growth "
    "share ratio weight proceeds? claims? premium insured branches? compet(?:itive)? non.compet(?:itive)? bids? allotted yield maturity coupon tenor face notified"
).split()
SUBDIVISION = r"(?i)\b(" + "|".join(SUBDIVISIONS) + r")\b"
HEADING_WORDS = (
    r"(?i)\b(distribution|number|percentage|proportion|ratio|rate|trends?|share|estimate[ds]?|coverage|prevalence|growth|index|average|summary|profile|indicators?|statistics?|status|composition"
    r"|classification|state[\s\-]?wise|district[\s\-]?wise|category[\s\-]?wise|by\s+(age|sex|state|district|sector|type|group|category|level))\b"
)
FRAGMENT = r"^-?[\p{Nd},]+(\.\p{Nd}+)?%?$"
INDEX_ONLY = r"^\(?\p{Nd}{1,2}\)?$"


def non_empty(r: Column) -> Column:
    return F.filter(F.transform(r, C.strip), lambda v: ~v.isin(*C.MISSING))


def tail_cells(r: Column) -> Column:
    return F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))


def clean_rows(rows: Column) -> Column:
    """Null-only rows and columns go, cells are normalised, garbage rows go, of equal rows the first stays."""
    kept = F.filter(rows, lambda r: F.exists(r, lambda v: v.isNotNull()))
    full = lambda rs: F.filter(M.indices(M.width(rs)), lambda i: F.exists(rs, lambda r: F.get(r, i).isNotNull()))
    dense = M.bind(kept, lambda rs: M.bind(full(rs), lambda own: F.transform(rs, lambda r: F.transform(own, lambda i: F.get(r, i)))))
    normal = F.transform(dense, lambda r: F.transform(r, normal_cell))
    return F.array_distinct(F.filter(normal, lambda r: ~is_garbage(r)))


def normal_cell(v: Column) -> Column:
    """Mid-word line wraps join, other white space becomes one space."""
    joined = F.regexp_replace(F.coalesce(v, F.lit("")), r"(?<=[a-z])\n(?=[a-z])", "")
    return C.strip(F.regexp_replace(joined, r"(?U)\s+", " "))


def is_garbage(r: Column) -> Column:
    text = F.lower(F.array_join(F.transform(r, lambda v: F.coalesce(v, F.lit("nan"))), " "))
    return text.rlike(r"^(¿\p{Nd}+à[\s,]*)+$") | text.rlike("^nan$|^unnamed|^none$")


def is_year_header(r: Column) -> Column:
    v = non_empty(tail_cells(r))
    n = M.count(v, C.is_year)
    return (F.size(v) >= 3) & (n >= 3) & (n >= F.size(v) * 0.7)


def is_month_header(r: Column) -> Column:
    v = non_empty(tail_cells(r))
    n = M.count(v, C.is_month)
    return (F.size(v) >= 3) & (n >= 3) & (n >= F.size(v) * 0.7)


def is_data(r: Column) -> Column:
    """A serial and three numbers, or numbers in most of at least three cells."""
    v = F.filter(F.transform(r, C.strip), lambda x: x != "")
    n = M.count(v, C.is_float)
    serial = C.strip(F.get(r, F.lit(0))).rlike(r"^\p{Nd}+$")
    return (F.size(v) >= 3) & (n >= 3) & (serial | (n >= F.size(v) * 0.6))


def data_start(rows: Column) -> Column:
    return M.first_index(rows, is_data)


def is_index_legend(r: Column) -> Column:
    """1 2 3 ... as printed under a header: small, ascending, in one cell each or together."""
    v = non_empty(r)
    tokens = F.flatten(F.transform(v, C.words))
    numbers = F.transform(tokens, lambda t: F.regexp_replace(C.ascii_digits(t), "[^0-9]", "").try_cast("int"))
    rising = F.forall(F.zip_with(F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))), F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(0))), lambda b, a: b > a), lambda ok: ok)
    ends = (F.get(numbers, F.lit(0)) <= 3) & (F.element_at(numbers, -1) <= 40)
    return F.when(F.size(tokens) >= 2, F.forall(tokens, lambda t: t.rlike(r"^\(?\p{Nd}{1,2}\)?$")) & rising & ends).otherwise(False)


def is_sub_header(r: Column, columns: Column) -> Column:
    """Labels without values that hold a word of subdivision."""
    v = non_empty(r)
    shape = F.forall(v, lambda x: ~x.rlike(C.NUMBER) & x.rlike("[A-Za-z]") & (C.word_count(x) <= 6))
    return (F.size(v) >= F.greatest(F.lit(2), F.floor(columns / 4))) & shape & F.array_join(v, " ").rlike(SUBDIVISION)


def is_numeric_only(r: Column) -> Column:
    values = tail_cells(r)
    return (C.strip(F.get(r, F.lit(0))) == "") & (F.size(values) > 0) & (M.count(values, C.is_number) >= F.greatest(F.lit(2), F.floor(F.size(values) / 2)))


def is_label_only(r: Column) -> Column:
    return (C.strip(F.get(r, F.lit(0))) != "") & (M.count(tail_cells(r), C.is_number) == 0)


def is_section_title(text: Column) -> Column:
    """A group's title, not a numbered line or the rest of a wrapped one."""
    return (text != "") & ~text.rlike(r"^\p{Nd}+\s*\.") & ~text.rlike(r"^(\p{Ll}|\()") & ~C.strip(text).endswith("(%)")


def is_orphan(r: Column) -> Column:
    """Values without a label."""
    return C.missing(F.get(r, F.lit(0))) & (M.count(tail_cells(r), C.is_number) >= 2)


def is_heading_line(line: Column) -> Column:
    """A line that reads like a title: few words, a capital first, mostly letters, no sentence marks, and title case or a word of headings."""
    s = C.strip(line)
    count = lambda sign: F.length(s) - F.length(F.replace(s, F.lit(sign), F.lit("")))
    letters, signs = F.length(F.regexp_replace(s, r"[^\p{L}]", "")), F.length(F.replace(s, F.lit(" "), F.lit("")))

    def judged(ws: Column) -> Column:
        titled = M.count(ws, lambda w: w.rlike(r"^\p{Lu}"))
        return F.size(ws).between(2, 16) & ((titled >= F.greatest(F.lit(2.0), 0.5 * F.size(ws))) | s.rlike(HEADING_WORDS))

    return s.rlike(r"^\p{L}") & ~s.rlike(r"^\p{Ll}") & ~s.rlike(r"[.;]\s|[.;]$|:$") & (count(")") <= count("(")) & (letters >= 0.6 * signs) & M.bind(C.words(s), judged)


def is_crushed(rows: Column) -> Column:
    """A quarter of the cells hold three lines, or one holds four fragments that are mostly numbers; an empty table is crushed."""
    v = M.flat(rows)
    lines = lambda x: F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), C.strip), lambda p: p != "")
    many = M.count(v, lambda x: F.length(F.regexp_replace(F.coalesce(x, F.lit("")), "[^\n]", "")) >= 2)
    run = F.exists(v, lambda x: (F.size(lines(x)) >= 4) & (M.count(lines(x), lambda p: p.rlike(FRAGMENT)) >= 0.7 * F.size(lines(x))))
    return (F.size(v) == 0) | (many > 0.25 * F.size(v)) | run


def spread_crushed_header(rows: Column) -> Column:
    """In the first eight rows a lone cell of several text fragments gives one to each slot to its right; the last takes the rest."""
    parts = lambda x: F.filter(F.transform(F.split(x, "\n"), C.strip), lambda p: p != "")

    def spread(r: Column) -> Column:
        at = M.first_index(r, C.populated)
        p = parts(F.get(r, at))
        slots = F.size(r) - at
        fires = (F.size(non_empty(r)) == 1) & (F.size(p) >= 3) & (M.count(p, C.is_number) <= 0.3 * F.size(p)) & (slots >= 2)
        placed = F.transform(r, lambda v, i: F.when(i < at, v).when(i - at < slots - 1, F.coalesce(F.get(p, i - at), F.lit(""))).otherwise(F.array_join(F.slice(p, slots, F.greatest(F.size(p) - slots + 1, F.lit(0))), " ")))
        return F.when(fires, placed).otherwise(r)

    return F.transform(rows, lambda r, i: F.when(i < 8, spread(r)).otherwise(r))


def header_missing(rows: Column) -> Column:
    """The rows above the first data row (a leading digit in the top eight) label too few columns with short labels."""
    at = M.first_index(M.head(rows, 8), lambda r: C.strip(F.get(r, F.lit(0))).rlike(r"^\(?\p{Nd}"))
    labels = lambda r: F.filter(F.transform(r, lambda v, i: F.struct(C.strip(v).alias("v"), i.alias("i"))), lambda x: ~x["v"].isin(*C.MISSING) & ~x["v"].rlike(INDEX_ONLY))
    short = F.filter(F.transform(M.head(rows, F.coalesce(at, F.lit(0))), labels), lambda x: F.forall(x, lambda c: C.word_count(c["v"]) <= 3))
    named = F.size(F.array_distinct(F.transform(F.flatten(short), lambda c: c["i"])))
    return F.when(at.isNull(), False).otherwise(named < F.greatest(F.lit(2.0), M.width(rows) * 0.5))

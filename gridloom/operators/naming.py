"""Roles of columns from their contents, names from headers, titles of tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.functions import cells as C
from gridloom.functions import text as X
from gridloom.operators import rows as R

# What the cells of each role look like, in the order in which roles are tried.
DOTTED = r"^\(?\p{Nd}{1,4}\.\p{Nd}{1,4}\)?$"
GROUP = r"^\p{Nd}{3,4}$"
SERIAL = r"^\(?\p{Nd}{1,3}\)?\.?$"
MONTHS = r"(?i)^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|jun(e)?|jul(y)?|aug(ust)?|sep(t|tember)?|oct(ober)?|nov(ember)?|dec(ember)?)([,'\s\-–]+\p{Nd}{2,4})?$"
LEVELS = (
    "division", "sub-division", "subdivision", "sub division", "group", "sub-group", "subgroup", "sub group", "family", "major", "minor", "unit", "section", "sub-major", "submajor",
    "class", "subclass", "sub-class",
)
STATES = (
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka", "kerala", "madhya pradesh",
    "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand",
    "west bengal", "jammu and kashmir", "ladakh", "delhi", "puducherry", "chandigarh",
)
STATE_PREFIX = r"(?i)^(?:\p{Nd}{1,3}\s*[.)]\s*)?(?:government\s+of\s+)?(?:the\s+)?(?:union\s+territory\s+of\s+)?(?:nct\s+of\s+)?"
YEARS = r"^(19|20)\p{Nd}{2}([-–/]\p{Nd}{2,4})?$"
PERCENT = r"^\(?-?\p{Nd}+(\.\p{Nd}+)?\s*%\)?$"
DATE = r"^\p{Nd}{1,2}[-/.]\p{Nd}{1,2}[-/.]\p{Nd}{2,4}$|^\p{Nd}{1,2}\s*[-/ ]\s*[A-Za-z]{3,9}\s*[-/ ]\s*\p{Nd}{2,4}$|^[A-Za-z]{3,9}\s+\p{Nd}{4}$"
CONFIDENT = ("code", "level", "state", "year", "percentage", "date", "month", "s_no")
#: Words a column name keeps whatever their vowels.
KEEP = "census table scheduled school students crop growth".split()


def state_core(v: Column) -> Column:
    return F.lower(C.strip(F.regexp_replace(F.regexp_replace(C.strip(v), STATE_PREFIX, ""), r"\s*[-–]\s*\p{Nd}{1,3}$", "")))


def is_serial_run(values: Column) -> Column:
    """Four in five are short numbers that begin at 2 or less and rise by 0 to 3."""
    own = F.filter(values, lambda v: v.rlike(SERIAL))
    n = F.transform(own, lambda v: F.regexp_replace(C.ascii_digits(v), "[^0-9]", "").try_cast("int"))
    steps = F.transform(n, lambda x, i: F.when(i > 0, x - F.get(n, i - 1)).otherwise(0))
    return (F.size(values) >= 3) & (F.size(own) >= 0.8 * F.size(values)) & (F.get(n, F.lit(0)) <= 2) & F.forall(steps, lambda d: d.between(0, 3))


def role(values: Column) -> Column:
    """What a column holds, by its filled cells; null when unclear."""

    def judged(v: Column) -> Column:
        mostly = lambda test, least=0.6: M.count(v, test) >= least * F.size(v)
        group = F.filter(v, lambda x: x.rlike(GROUP))
        assigned = (F.size(F.array_distinct(F.transform(group, F.length))) == 1) | F.exists(group, lambda x: x.startswith("0"))
        return (
            F.when(F.size(v) == 0, F.lit(None)).when(mostly(lambda x: x.rlike(DOTTED)), "code").when((F.size(group) >= 0.6 * F.size(v)) & assigned, "code").when(is_serial_run(v), "s_no")
            .when(mostly(lambda x: x.rlike(MONTHS)), "month").when(mostly(lambda x: F.lower(x).isin(*LEVELS)), "level").when(mostly(lambda x: state_core(x).isin(*STATES)), "state")
            .when(mostly(lambda x: x.rlike(YEARS)), "year").when(mostly(lambda x: x.rlike(PERCENT)), "percentage").when(mostly(lambda x: x.rlike(DATE)), "date")
            .when(mostly(lambda x: C.lettered_words(x) >= 2, 0.5), "name")
        )

    return M.bind(F.filter(F.transform(values, C.strip), lambda x: ~F.lower(x).isin(*C.BLANK)), judged)


def confident_role(values: Column) -> Column:
    return M.bind(role(values), lambda r: F.when(r.isin(*CONFIDENT), r))


def dedupe_names(names: Column) -> Column:
    """Later repeats get the first free suffix from _2 on."""

    def add(used: Column, n: Column) -> Column:
        free = F.filter(F.transform(F.sequence(F.lit(2), F.size(used) + 2), lambda k: F.concat(n, F.lit("_"), k.cast("string"))), lambda x: ~F.array_contains(used, x))
        return F.concat(used, F.array(F.when(F.array_contains(used, n), F.get(free, F.lit(0))).otherwise(n)))

    return F.aggregate(names, F.array().cast("array<string>"), add)


def reference_names(rows: Column, names: Column) -> Column:
    """Roles where there are any, else the old names; repeats get _1, _2 and so on."""
    made = M.by_column(rows, lambda v, i: F.coalesce(role(v), F.get(names, i)))
    return M.bind(made, lambda m: F.transform(m, lambda n, i: M.bind(M.count(F.slice(m, 1, i), lambda x: x == n), lambda k: F.when(k > 0, F.concat(n, F.lit("_"), k.cast("string"))).otherwise(n))))


def is_numeric_column(values: Column) -> Column:
    v = F.filter(F.transform(values, C.strip), lambda x: ~F.lower(x).isin(*C.HEADER_PLACEHOLDERS))
    return (F.size(v) > 0) & (M.share(v, lambda x: x.rlike(C.NUMBER)) >= 0.8)


def is_label_column(values: Column) -> Column:
    v = F.filter(F.transform(values, C.strip), lambda x: ~F.lower(x).isin(*C.HEADER_PLACEHOLDERS))
    texty = M.share(v, lambda x: ~x.rlike(C.NUMBER) & x.rlike("[A-Za-zऀ-ॿ]"))
    return (F.size(v) > 0) & (F.size(v) >= F.greatest(F.lit(2.0), 0.5 * F.size(values))) & (texty >= 0.6)


def clean_names(rows: Column, names: Column, drop_second: bool = True, keep: tuple[str, ...] = tuple(KEEP)) -> Column:
    """A struct of unique clean ``names`` and the indices of the columns that stay (``own``).

    Nameless columns are named by a confident role, as value (not the first) or as label. Where a
    district column exists, the second column goes unless it is that one.
    """

    def one(n: Column, i: Column) -> Column:
        v = M.column(rows, i)
        nameless = n.isNull() | n.rlike("^col(_[0-9]+)?$")
        given = F.when(nameless, F.coalesce(confident_role(v), F.when((i > 0) & is_numeric_column(v), "value").when(is_label_column(v), "label")))
        return F.coalesce(given, n, F.concat(F.lit("col_"), i.cast("string")))

    raw = F.transform(names, lambda n, i: one(X.clean_column_name(n, keep), i))

    def kept(m: Column) -> Column:
        drops = F.array_contains(m, "district") & (F.size(m) > 2) & (F.get(m, F.lit(1)) != "district") & F.lit(drop_second)
        own = F.filter(M.indices(F.size(m)), lambda i: ~(drops & (i == 1)))
        return F.struct(dedupe_names(F.transform(own, lambda i: F.get(m, i))).alias("names"), own.alias("own"))

    return M.bind(raw, kept)


def table_name(rows: Column, header_rows: Column, caption: Column) -> Column:
    """A numbered title of caption or header cells, a numbered section, a caption line, or a lone cell of the top three rows."""
    in_header = F.filter(F.transform(M.flat(M.head(rows, header_rows)), X.numbered_title), lambda t: t.isNotNull())
    section = r"^\s*(\p{Nd}+(?:\.\p{Nd}+)+)[\s\-–:]+([^(\n]{3,90})"
    words = C.words(F.regexp_replace(C.strip(F.regexp_extract(caption, section, 2)), r"[–\- ]+$", ""))
    numbered = F.when(caption.rlike(section) & (M.count(words, lambda w: w.rlike("[A-Za-z]")) >= 2), F.concat_ws(" ", F.regexp_extract(caption, section, 1), F.array_join(F.slice(words, 1, 18), " ")))
    lines = F.filter(F.transform(F.split(caption, "\n"), lambda t: X.plain_title(t)), lambda t: t.isNotNull())
    lone = F.filter(F.transform(M.head(rows, 3), lambda r: F.when(F.size(R.non_empty(r)) == 1, X.plain_title(F.get(R.non_empty(r), F.lit(0)), 0.5))), lambda t: t.isNotNull())
    return F.coalesce(X.numbered_title(caption), F.get(in_header, F.lit(0)), numbered, F.get(lines, F.lit(0)), F.get(lone, F.lit(0)))


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def named_fraction(names: Column) -> Column:
    return M.count(names, lambda n: ~n.rlike("^(col|value|code|label)(_[0-9]+)?$")) / F.greatest(F.size(names), F.lit(1))


def is_strong_title(name: Column) -> Column:
    return F.coalesce(C.strip(name).rlike(r"(?i)^(table|tabel|statement|annexure|appendix)\b|^\p{Nd}{1,2}(\.\p{Nd}{1,2})+\s"), F.lit(False))


def are_entity_variants(a: Column, b: Column) -> Column:
    """Titles of one series for different entities: the same last two words, another first one."""
    ws = lambda t: F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"[\s\-–:]+"), lambda w: w != "")
    x, y = ws(a), ws(b)
    ends = (F.element_at(x, -1) == F.element_at(y, -1)) & (F.element_at(x, -2) == F.element_at(y, -2))
    return F.when((F.size(x) >= 3) & (F.size(y) >= 3), ends & (F.get(x, F.lit(0)) != F.get(y, F.lit(0)))).otherwise(False)


def names_match(a: Column, b: Column, least: float) -> Column:
    """That share of the first list's names equals or begins the second's (four letters at least), or the other way round."""
    same = lambda x, y: (x == y) | ((F.length(x) >= 4) & (F.length(y) >= 4) & (x.startswith(y) | y.startswith(x)))
    hits = F.filter(F.transform(a, lambda n, i: F.when(i < F.size(b), same(normal_name(n), normal_name(F.get(b, i)))).otherwise(False)), lambda ok: ok)
    return (F.size(a) > 0) & (F.size(hits) >= least * F.size(a))

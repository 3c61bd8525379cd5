r"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL functions only.

Paragraphs are lines; long lines go on to be cut at sentence ends once 80 characters are reached, and at
400 at the latest. A digest is 40 bits of a hash and a 24-bit check of them. A sketch has three tables
of S x S cells; each distinct digest is XORed into one cell of each. The XOR of two sketches is the
sketch of the digests that are in one of them only; a cell whose check holds gives up a digest, which leaves
its other cells, and so on (peeling). If cells stay, the XOR of two larger ones is built from both texts' digests: first for the number
of digests at hand, then four times that; a difference that even then resists (two digests in the same three
cells) is counted from the digests themselves. Likeness is 1 - |difference| / (|a| + |b|).

The fingerprint is the sketch with S = 4, its cells in hex with dots between.

Edge cases: null text counts as empty, has no digests and the fingerprint of zeros; two empty ones have
likeness 1. The next document has the next larger id, after the last comes the first; of rows that share an
id one of the smallest text hash stands for it, and all of them have the same next. Rows with a null id have no
next (an empty text). Repeated rows repeat; other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Cuts

BASE = 4
ROUNDS = 60
PARAGRAPH = r"[^\n]{80,400}?[.!?|](?=\s)|[^\n]{1,400}"
_CHECK = "(xxhash64({x} & -16777216L) & 16777215L)"


def digests(text: F.Column) -> F.Column:
    """Distinct paragraph digests, each with its own check."""
    hashed = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p).bitwiseAND(F.lit(-16777216).cast("long")))
    return F.array_distinct(F.transform(hashed, lambda h: h.bitwiseOR(F.xxhash64(h).bitwiseAND(F.lit(16777215).cast("long")))))


def cells(d: str, s: str) -> str:
    """SQL of the 3 * s * s cells of the digests ``d``, which are filtered by row of cells first; digests that are there twice cancel out."""
    return f"""flatten(transform(sequence(0, 2), j ->
      transform(array(transform({d}, x -> struct(cast(pmod(xxhash64(x, j), {s} * {s}) div {s} AS int) AS g, cast(pmod(xxhash64(x, j), {s}) AS int) AS l, x AS v))), t ->
        flatten(transform(sequence(0, {s} - 1), g ->
          transform(array(filter(t, y -> y.g = g)), u -> if(size(u) = 0, array_repeat(0L, {s}),
            transform(sequence(0, {s} - 1), l -> aggregate(u, 0L, (acc, y) -> if(y.l = l, acc ^ y.v, acc)))))[0])))[0]))"""


def peeled(x: str, s: str) -> str:
    """SQL of the digests a difference sketch gives up; null unless its cells end up empty."""
    pure = f"array_distinct(filter(st.x, v -> v <> 0L AND {_CHECK.format(x='v')} = (v & 16777215L)))"
    step = f"""if(st.done, st, transform(array({pure}), p -> if(size(p) = 0, named_struct('x', st.x, 'r', st.r, 'done', true),
        named_struct('x', zip_with(st.x, {cells('p', s)}, (a, b) -> a ^ b), 'r', concat(st.r, p), 'done', false)))[0])"""
    begin = f"named_struct('x', {x}, 'r', cast(array() AS array<bigint>), 'done', false)"
    end = "if(forall(st.x, v -> v = 0L) AND size(array_distinct(st.r)) = size(st.r), st.r, NULL)"
    return f"aggregate(sequence(1, {ROUNDS}), {begin}, (st, i) -> {step}, st -> {end})"


def difference_size(a: str, b: str, xa: str, xb: str) -> str:
    """SQL of how many digests are in one of the columns ``a`` and ``b`` only; ``xa, xb``: their base sketches."""
    side = lambda times: f"cast(greatest({BASE}, ceil(sqrt({times} * 0.6 * (size({a}) + size({b}))))) AS int)"
    larger = lambda times: f"transform(array({side(times)}), s -> size({peeled(cells(f'concat({a}, {b})', 's'), 's')}))[0]"
    first = f"size({peeled(f'zip_with({xa}, {xb}, (c, e) -> c ^ e)', str(BASE))})"
    known = lambda q: f"transform(array({q}), z -> if(z >= 0, z, NULL))[0]"  # noqa: E731  size(NULL) is -1 or NULL; nullif would peel twice
    return f"coalesce({known(first)}, {known(larger(1))}, {known(larger(4))}, size(array_except({a}, {b})) + size(array_except({b}, {a})))"


def likeness(a: str, b: str, xa: str, xb: str) -> F.Column:
    total = f"(size({a}) + size({b}))"
    return F.expr(f"if({total} = 0, 1D, 1D - ({difference_size(a, b, xa, xb)}) / cast({total} AS double))")


def _next_of(cuts: Cuts, rows: DataFrame) -> DataFrame:
    """``id, before, reach, th``: each id with the id before it, how much of its text that one needs, and its text hash.

    Ids are written in range partitions; a window runs inside each, and one over a row per partition
    connects them.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.filter("id is not null").groupBy("id").agg(F.max(F.char_length("t")).alias("n"), F.min(F.xxhash64("t")).alias("th"))
    ids = cuts.write(ids.repartitionByRange(partitions, "id").withColumn("part", F.spark_partition_id()))
    ends = ids.groupBy("part").agg(F.max(F.struct("id", "n")).alias("last"))
    chain = Window.orderBy("part")
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(chain), F.last("last").over(whole)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("id")
    before = F.coalesce(F.lag(F.struct("id", "n")).over(inside), F.col("ahead"))
    return ids.join(ends, "part").select("id", "th", before.alias("b")).select("id", "th", F.col("b.id").alias("before"), F.floor(F.col("b.n") / 4).cast("int").alias("reach"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row."""
    cuts = Cuts(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    order = cuts.write(_next_of(cuts, rows))
    base = str(BASE)
    # both joins read one exchange of the texts by id
    named, nameless = rows.filter("id IS NOT NULL"), rows.filter("id IS NULL")
    following = (
        named.join(order, "id").filter(F.xxhash64("t").bitwiseXOR(F.col("th")) == 0)  # not a second join key, which would deal the texts anew
        .select(F.col("before").alias("id"), F.substring("t", F.lit(1), F.col("reach")).alias("head"), digests(F.col("t")).alias("b"))
        .dropDuplicates(["id"])
    )
    n = F.char_length("t")
    quarter = F.floor(n / 4).cast("int")
    joined = (
        named.join(following, "id", "left").unionByName(nameless, allowMissingColumns=True)
        .withColumn("n_chars", n.cast("long"))
        .withColumn("edited", F.concat(F.substring("t", F.lit(1), n - quarter), F.coalesce(F.substring("head", F.lit(1), quarter), F.lit(""))))
        .withColumn("a", digests(F.col("t")))
        .withColumn("e", digests(F.col("edited")))
        .withColumn("b", F.coalesce("b", F.expr("cast(array() AS array<bigint>)")))
    )
    sketched = joined.withColumn("xa", F.expr(cells("a", base))).withColumn("xe", F.expr(cells("e", base))).withColumn("xb", F.expr(cells("b", base)))
    text = lambda x: F.array_join(F.transform(x, lambda v: F.lower(F.hex(v))), ".")
    return sketched.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), text("xa").alias("fingerprint"), text("xe").alias("edited_fingerprint"),
        likeness("a", "e", "xa", "xe").alias("near_edited"), likeness("a", "b", "xa", "xb").alias("near_next"),
    )

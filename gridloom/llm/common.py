"""Shared helpers: input tables, lineage cuts in the shared checkpoint folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A batch of texts handed to numpy or a tokenizer at once holds about so many characters at most.
BATCH_CHARS = 4_000_000

#: Spark's setting for the size at which a batch on its way to a Python worker ends, and what ``small_batches`` sets.
_BATCH_BYTES, SMALL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 7_900_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def n_bytes(text: str | None) -> int:
    return len(text.encode("utf-8", "surrogatepass")) if text else 0


def slices(batch: pa.RecordBatch, text_at: int, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of text each (one row at least)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_at)), 0).to_pylist()
    begin = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += size
    if begin < len(sizes):
        yield batch.slice(begin)
    pa.default_memory_pool().release_unused()  # between batches, as workers live on beside others


def small_batches(spark: SparkSession) -> None:
    """Batches of a few MB from the JVM to Python workers in this session, unless it has a size of its own.

    Spark ends a batch at 10,000 rows or 64 MB, held by the JVM outside its heap and by the worker, while ``slices`` hands on
    4 MB of it at a time (so a batch is just under two of those). Rows stay the same, and a single one may be larger.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(SMALL_BATCH))


_SIMPLE = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow_schema(columns: T.StructType | str) -> pa.Schema:
    """Of a schema, or of simple columns written as "name type, ..." (executors can't parse DDL)."""
    if isinstance(columns, T.StructType):
        return to_arrow_schema(columns)
    return pa.schema([(name, _SIMPLE[kind]) for name, kind in map(str.split, columns.split(","))])


def map_texts(docs: DataFrame, id_col: str, text_col: str, ddl: str, run: Callable[[list[str | None]], dict]) -> DataFrame:
    """Row by row: the id as it is (nulls included) and the columns that ``run`` makes of a list of texts."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL(ddl).fields])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(schema)
        for whole in batches:
            for batch in slices(whole, 1):
                made = run(batch.column(1).to_pylist())
                columns = [batch.column(0).cast(arrow.field(0).type), *(pa.array(made[f.name], f.type) for f in list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(mapped, schema)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set and all executors are threads of the driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Spark's setting by which an execution's shuffle files go when it ends.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Cuts:
    """Tables written to the shared folder, so that later steps don't recompute what led to them.

    Nothing reads a write's shuffle files once the table stands (each execution plans its own), yet Spark keeps them until
    the driver collects its garbage, whatever the disk holds by then. So they go with the write.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        before = self.spark.conf.get(_SHUFFLES_GO, None)
        self.spark.conf.set(_SHUFFLES_GO, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_SHUFFLES_GO)
            else:
                self.spark.conf.set(_SHUFFLES_GO, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._gridloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a cut that nothing reads any more."""
        self._delete(df._gridloom_path)

    def clear(self) -> None:
        """Delete all cuts, when nothing reads them any more."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running(cuts: Cuts, df: DataFrame, order: list[F.Column], values: dict[str, F.Column]) -> DataFrame:
    """``df`` with, for each of ``values``, the sum over all rows that come before in ``order`` (which is total).

    Rows are written in range partitions; a window runs inside each, and one over a row per partition
    connects them, so no task holds the table.
    """
    parts = cuts.write(df.select("*", *(v.alias(f"_v_{n}") for n, v in values.items())).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(F.col("_part").alias("_at")).agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values))
    totals = totals.select("_at", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in values))  # a row for each partition
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.join(F.broadcast(totals), F.col("_part") == F.col("_at"))
    return joined.select(*df.columns, *((F.col(f"_b_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0))).alias(n) for n in values))


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """A broadcast hint only where a count shows that the side stays under ``limit`` bytes; beyond it the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def components(spark: SparkSession, edges: DataFrame, cuts: Cuts, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): ``node, component`` with the smallest node reachable.

    Large-star and small-star steps alternate until neither changes the edge set. Each step is a
    minimum per node (combined before the shuffle) and an equi-join back, so a node with very many
    links never meets them in one task. Nodes without links are not returned.
    """
    star = cuts.write(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = None
    for _ in range(max_rounds):
        both = star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = (
            joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low2.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = cuts.write(small)
        now = new.agg(F.count("*"), F.expr("coalesce(sum(xxhash64(u, v) % 1000003), 0)"), F.expr("bit_xor(xxhash64(v, u))")).first()
        cuts.drop(star)
        star = new
        if mark == now:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

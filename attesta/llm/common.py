"""Small shared helpers: tables in the cluster's shared folder, checked broadcasts, distributed numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts: space and the ASCII characters from tab to carriage return.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"

#: A lookup table of at most so many rows is broadcast; a larger one is joined by sort-merge.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Without one, a temporary folder serves a single machine
    (master local, as in tests), and a cluster is an error."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="attesta-shared-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


#: Spark removes the shuffle files of a query when it has ended, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a batch that goes to a Python worker and comes back, which executors hold outside of the heap on both sides.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives later joins true sizes. What was shuffled for it goes once it is written.
    Tables with texts are packed by Zstandard, numbers by Spark's default.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attesta/{name}-{uuid.uuid4().hex}"
    options = {SHUFFLES_GO: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path, compression="zstd" if "string" in df.schema.simpleString() else None)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `stored` gave, once no frame that is still to be computed reads them."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Where columns that an operator doesn't read are carried, so that none of their names can clash with its own.
CARRIED = "_carried"


def carried(docs: DataFrame, used: list[str]) -> DataFrame:
    """The columns that an operator reads, and all others as one struct."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*others) if others else F.lit(0)).alias(CARRIED))


def restored(df: DataFrame, columns: list[str], used: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns as they were before `carried`, in their order; `changed` ones have new values."""
    own = lambda c: F.col(c) if c in used else F.col(CARRIED).getField(c)
    return df.select(*((changed or {}).get(c, own(c)).alias(c) for c in columns))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(left: DataFrame, right: DataFrame, on: Column | list, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large left side with a lookup table (already stored, so that counting it is cheap).

    The lookup is broadcast only if its row count is within `rows`; beyond that it is a sort-merge
    join, whose skewed partitions AQE splits.
    """
    small = right.count() <= rows
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def _row_in_partition(col: str) -> Column:
    return F.col(col).bitwiseAND(F.lit((1 << 33) - 1))


def numbered(df: DataFrame, order: list[Column], name: str, group: str | None = None) -> DataFrame:
    """Add a gapless long `name` from 0, in the given order, within each value of `group` if given.

    One range exchange; no partition holds more than its range. Only a count per partition (and group) is
    gathered, and offsets come from those. The ordering must start with `group` where that is given. Rows that
    tie in all of `order` get consecutive numbers in the order of df, and are split over partitions like any others.
    """
    spark = df.sparkSession
    keys = [*order, F.col("_tie")]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys).drop("_tie")
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), f"numbered-{name}")
    keys = [F.shiftright("_at", 33).alias("_part")] + ([F.col(group).alias("_group")] if group else [])
    # one row for each partition and group: at most partitions + groups rows, as partitions are ranges
    counts = stored(ranged.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(_row_in_partition("_at")).alias("_least")), f"counts-{name}")
    earlier = Window.partitionBy(*(["_group"] if group else [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*counts.columns, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")).drop("_n")
    offsets = stored(offsets, f"offsets-{name}").withColumnRenamed("_part", "_p").withColumnRenamed("_group", "_g")
    on = F.shiftright("_at", 33) == F.col("_p")
    if group:
        on = on & F.col(group).eqNullSafe(F.col("_g"))
    joined = lookup_join(ranged, offsets, on)
    number = _row_in_partition("_at") - F.col("_least") + F.col("_before")
    return joined.select(*df.columns, number.cast("long").alias(name))

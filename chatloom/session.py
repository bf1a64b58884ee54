"""Session settings and the few places where physical size matters."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Inputs the optimizer expects to be below this many bytes, a few million rows even
# if they are packed well, cannot hold a group too big for one task; anything larger is
# measured before it is trusted.
SMALL_INPUT_BYTES = "chatloom.smallInputBytes"
SMALL_INPUT_DEFAULT = 8 * 1024 * 1024
# Inputs of few files up to this size are dealt out before costly work on their rows.
SPREAD_BYTES = 64 * 1024 * 1024
# The largest number of rows one task may be asked to hold in order.
HOT_GROUP_ROWS = "chatloom.hotGroupRows"
HOT_GROUP_DEFAULT = 500_000


def build_session(app: str = "chatloom", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage into reliable storage, so that lost executors do not
    change what later steps see.  The folder is the cluster's; only a local
    session without one gets a folder of its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="chatloom-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; runs no job."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def slices_for_hot_groups(df: DataFrame, keys: list[str]) -> int:
    """0 if every group of `keys` fits one task, else into how many slices the rows go so
    that each holds no more than a task should.  Small inputs are answered from the
    estimate; larger ones by one map-side combined count, of which two numbers come back."""
    conf = df.sparkSession.conf
    if estimated_bytes(df) <= int(conf.get(SMALL_INPUT_BYTES, str(SMALL_INPUT_DEFAULT))):
        return 0
    limit = int(conf.get(HOT_GROUP_ROWS, str(HOT_GROUP_DEFAULT)))
    largest, rows = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    if (largest or 0) <= limit:
        return 0
    least = int(conf.get("spark.sql.shuffle.partitions"))
    # A limit set below any sensible one, as in tests, does not make a slice per row.
    return max(least, -(-rows // max(limit, 10_000)))


def spread(df: DataFrame) -> DataFrame:
    """Deal out a small input, which Spark would read in one task or a few, ahead of
    work on its texts that costs far more than reading them.  Small means a fixed
    size, whatever the cluster: larger inputs are never shuffled for this."""
    if estimated_bytes(df) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def listed_by_few(spark: SparkSession) -> SparkSession:
    """Have folders of many small files listed by a few tasks per core.  Spark's way, a task
    for nearly every folder, costs far more than the listing."""
    tasks, key = max(32, 4 * spark.sparkContext.defaultParallelism), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if int(spark.conf.get(key, "10000")) > tasks:
        spark.conf.set(key, str(tasks))
    return spark


# Bytes of input to a task whose rows each become many: its memory follows what it makes.
DEALT_BYTES = 4 * 1024 * 1024
# Estimates from here on mean that the optimizer does not know.
UNKNOWN_BYTES = 1 << 50


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, or, where it has none, the bytes counted in one job."""
    known = estimated_bytes(df)
    return known if known < UNKNOWN_BYTES else counted_bytes(df)


def counted_bytes(df: DataFrame) -> int:
    """About how many bytes the rows have, counted in one job."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() == "string" else F.lit(8) for f in df.schema.fields]
    return df.select(sum(sizes, F.lit(0).cast("long")).alias("b")).agg(F.sum("b")).first()[0] or 0


# A table up to this many bytes is sent to all tasks.
SENT_BYTES = 8 * 1024 * 1024


def sent(df: DataFrame, size: int | None = None) -> DataFrame:
    """A stored table, sent to all tasks if its `size`, else its counted bytes, allow.  The
    optimizer keeps the estimate of the plan that made a stored table; left to it, the other
    side of a join is shuffled before it can know better."""
    return F.broadcast(df) if (counted_bytes(df) if size is None else size) <= SENT_BYTES else df


def dealt(df: DataFrame, *keys: str, size: int = DEALT_BYTES) -> DataFrame:
    """Deal out an input of any size by a hash of `keys`, about `size` bytes to a task and at
    least one task per core, ahead of work that makes far more rows than it reads."""
    return df.repartition(tasks_for(df, size), *keys)


def tasks_for(df: DataFrame, size: int = DEALT_BYTES) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // size))

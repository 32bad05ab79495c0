"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores="*", shuffle_partitions=8, app="lunario"):
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_LOCAL = []


def scratch_path(spark, name):
    """A fresh path in the shared folder named by spark.checkpoint.dir.

    Only where that setting is absent and the session runs on one machine, as
    in tests, is a temporary folder made for it. Whoever sets the folder owns
    what is left in it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="run-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by=()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives executor loss and gives later joins the true size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys, buckets=None) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``keys`` and read it back.

    What groups, windows or joins by the keys afterwards needs no exchange, in as
    many jobs as read the table. The table's name lives in the session only.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    title = f"{name}_{path[-32:]}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(title)
    return spark.table(title)


def values_frame(spark, names, rows) -> DataFrame:
    """A small constant table (registries, parameter grids) built inside the plan."""
    structs = [F.struct(*[_lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _lit(value) -> Column:
    if isinstance(value, float):
        return F.lit(value).cast("double")
    return F.lit(value)

"""Results replaced as a whole.

A version of a result is a set of tables written aside, under a name of its own.
What makes it the current one is a manifest, a single row appended to the folder of
manifests when all its tables are complete; an append of one row shows up whole or
not at all. Readers follow the latest manifest. A run that breaks off before leaves
the old version in place, tables without a manifest are never read, and a reader
that has begun on a version keeps it.

One writer at a time: of two that commit at once, the one with the larger name wins.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

MANIFEST = "number long, version string, tables array<string>"


def _manifests(spark, target):
    try:
        return spark.read.schema(MANIFEST).json(f"{target}/manifests")
    except AnalysisException as error:  # nothing committed yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def current_version(spark, target):
    """The manifest row of the current version, or None."""
    return _manifests(spark, target).orderBy(F.desc("number"), F.desc("version")).first()


def write_version(tables, target):
    """Write ``tables`` (name to DataFrame) aside; returns the version's name, which no reader knows yet."""
    version = uuid.uuid4().hex
    for name, frame in tables.items():
        frame.write.parquet(f"{target}/versions/{version}/{name}")
    return version


def publish_version(spark, target, version, names):
    """Make a completely written version the current one."""
    last = current_version(spark, target)
    row = [((last["number"] if last else 0) + 1, version, sorted(names))]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{target}/manifests")


def replace(tables, target):
    """Write and publish ``tables`` as the new current version of ``target``: all of them or none."""
    spark = next(iter(tables.values())).sparkSession
    publish_version(spark, target, write_version(tables, target), tables)


def read_current(spark, target, name):
    """A table of the current version."""
    manifest = current_version(spark, target)
    if manifest is None or name not in manifest["tables"]:
        raise ValueError(f"{target} has no current version with a table {name}")
    return spark.read.parquet(f"{target}/versions/{manifest['version']}/{name}")

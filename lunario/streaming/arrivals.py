"""Cleaning of files as they arrive in a folder.

The file source hands over whole files, so a file never spans two batches and
each batch is scanned exactly like a folder read at once.
"""

from lunario.sources.delimited import FILE_FIELDS, observations, with_position


def observations_of_batch(lines):
    return observations(with_position(lines))


def clean_arrivals(spark, folder, out, checkpoint, **trigger):
    """Start appending the observations of new files in ``folder`` to ``out`` (Parquet).

    ``trigger`` is passed on, ``availableNow=True`` when none is given. A batch
    that is run again after a failure replaces its own output.
    """

    def append(lines, batch_id):
        observations_of_batch(lines).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    lines = spark.readStream.format("text").load(folder).select("value", *FILE_FIELDS)
    writer = lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()

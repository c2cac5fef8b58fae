"""Continuous loading: points arrive in files and leave as patches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lidarlake.functions.keys import Key
from lidarlake.operators.grouping import build_patches
from lidarlake.operators.layout import check_pcid, write_patches


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark wrote into the checkpoint when the query first began."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def load_patches(
    points: DataFrame,
    key: Key,
    path: str,
    checkpoint: str,
    layout: Callable[[DataFrame], DataFrame] | None = None,
    once: bool = False,
    **options,
) -> StreamingQuery:
    """Group every micro-batch into patches and add them to the table at ``path``.

    A batch goes to ``load=<id>/batch_id=<n>`` and replaces what a failed attempt left there,
    so each point is stored once. The id is the query's own, kept in its checkpoint, so several
    streams can fill one table. Patches never span batches, as loading file by
    file would have it; regroup the table to merge them. ``once`` stops when all
    files present are loaded.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        # The batch is read for the group sizes and again for the points.
        batch = batch.persist()
        try:
            patches = build_patches(batch, key, **options)
            ordered = layout(patches) if layout else patches
            check_pcid(ordered, path)
            folder = f"{path}/load={_query_id(batch.sparkSession, checkpoint)}/batch_id={batch_id}"
            write_patches(ordered, folder, mode="overwrite")
        finally:
            batch.unpersist()

    writer = points.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

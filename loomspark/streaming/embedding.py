"""Embedding as a stream that may stop anywhere: each batch is one commit of a snapshot table, and repeating it changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.sources.snapshots import SnapshotTable

VECTORS = "id string, vector array<float>, model string, batch bigint"


def embed_batch(batch: DataFrame, number: int, table: SnapshotTable, model: str, embed: Callable[[Column], Column]) -> int:
    """Commit the vectors of a batch's chunks (id, text) that the table does not hold under ``model`` yet; the table's version.

    The batch's part has the batch's number in its name, so a batch that a stream repeats after a failure replaces itself.
    Vectors of other models go in the same commit: a reader never sees two models.
    """
    own, prefix = f"{model}/{number}", f"{model}/"
    held = table.read(versions=True).where(F.col("part").startswith(prefix) & (F.col("part") != own)).select("id")
    rows = batch.where("id is not null and text is not null").select(F.col("id").cast("string").alias("id"), "text").dropDuplicates(["id"]).join(held, "id", "left_anti")
    others = table.live().where(~F.col("part").startswith(prefix)).select("part")
    vectors = rows.select("id", embed(F.col("text")).cast("array<float>").alias("vector"), F.lit(model).alias("model"), F.lit(number).cast("long").alias("batch"))
    return table.commit(vectors, own, others)


def embed_stream(chunks: DataFrame, table: SnapshotTable, model: str, embed: Callable[[Column], Column], checkpoint: str):
    """A started query that embeds a stream of chunks; what a stopped one has committed is not embedded again.

    Spark's checkpoint names the batch to go on with; the table's log says whether it has been committed before.
    """

    def commit(batch: DataFrame, number: int) -> None:
        embed_batch(batch, number, table, model, embed)

    return chunks.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Running statistics over arriving points."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import stats
from ..operators.transforms import Colouring
from ..plans.kd import Plan
from ..storage import File, write


def running_bounds(points: DataFrame, *by: str) -> DataFrame:
    """Box and count of all points so far, by group; for update or complete mode."""
    return stats.bounds(points, *by)


def leaf_counts(points: DataFrame, plan: Plan) -> DataFrame:
    """How many points have arrived in each leaf of a plan that stands."""
    return plan.routed(points).groupBy("leaf").agg(F.count("*").alias("n"), *stats.bounds_columns())


def windowed_ranges(points: DataFrame, time: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Range and count of an attribute by time window; later rows than the watermark allows are left out."""
    points = points.withColumn(time, F.col(time).cast("timestamp"))
    return points.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "min", "max", "n")


def coloured(points: DataFrame, colouring: Colouring, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Colour arriving points over the range of the first batch that has any, which then stands: a table with a folder for each batch.

    The range is kept beside the checkpoint, so a query that is started again goes on with it; a new checkpoint
    observes anew.  A batch that is run again overwrites its own folder.
    """
    kept = f"{checkpoint}/colour-range.json"

    def run(batch: DataFrame, number: int) -> None:
        try:
            with File(kept) as f:
                span = tuple(json.loads(f.read(0, f.size)))
        except FileNotFoundError:
            if batch.isEmpty():
                return
            span = colouring.span(batch)
            write(kept, json.dumps(span).encode())
        colouring.apply(batch, span).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return points.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_routed(points: DataFrame, plan: Plan, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Route arriving points to leaves and append them to a table that is partitioned by leaf."""
    routed = plan.routed(points)
    return routed.writeStream.format("parquet").partitionBy("leaf").option("path", folder).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Point comparison on Structured Streaming inputs.

* ``heights_stream`` -- row-local steps (axis roles given explicitly, zone,
  projection, key) and a stream-static left join with a height table.  It
  is stateless, so it runs in append mode without a watermark.
* ``start_compare_stream`` -- the full comparison (nearest pair, heights,
  differences, flag) per micro-batch through ``foreachBatch``.  Each batch
  is written to its own ``batch_id=N`` folder with overwrite, so a batch
  replayed after a failure replaces its earlier output instead of
  duplicating it.  Axis roles must be given: a stream has no first row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numeric import zone_of
from ..functions.projection import project_2000_to_1992
from ..operators.axes import Roles
from ..operators.lookup import join_heights, with_height_key
from ..plans.pipelines import compare
from ..session import ensure_checkpoint_dir


def project_with_roles(df: DataFrame, roles: Roles) -> DataFrame:
    t = df.withColumns({"__n": F.col(roles.northing), "__e": F.col(roles.easting)})
    t = t.withColumn("__zone", zone_of("__e"))
    t = project_2000_to_1992(t, "__n", "__e", "__zone")
    return with_height_key(t).drop("__n", "__e", "__zone")


def heights_stream(points: DataFrame, heights: DataFrame, roles: Roles = Roles("x", "y"),
                   out: str = "h_ref") -> DataFrame:
    """Streaming points (id, x, y, ...) with the terrain height of a static table."""
    return join_heights(project_with_roles(points, roles), heights, out=out)


def start_compare_stream(points: DataFrame, sink_path: str, *, key: str,
                         reference: DataFrame | None = None, heights: DataFrame | None = None,
                         checkpoint_location: str | None = None, trigger: dict | None = None,
                         **compare_args) -> StreamingQuery:
    """Run ``pipelines.compare`` on every micro-batch of ``points``.

    The checkpoint location defaults to a folder under the session's
    checkpoint directory that is named after the sink, so that a restarted
    stream finds its own and two streams never share one.
    """
    spark = points.sparkSession
    if checkpoint_location is None:
        name = hashlib.sha256(sink_path.encode()).hexdigest()[:16]
        checkpoint_location = f"{ensure_checkpoint_dir(spark)}/compare-stream-{name}"

    def run(batch: DataFrame, batch_id: int) -> None:
        res = compare(batch, key=key, reference=reference, heights=heights, sort=False, keep=[key],
                      **compare_args)
        res.write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")

    w = points.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()

"""Queries over the streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.lineage import shared_dir
from ..streaming import ingest
from .registry import query, table


@query("""SELECT event_type AS grp, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type""")
def st01_incremental_ingest(spark, sf):
    """The events folder handled twice: the second call finds nothing new."""
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf, "events")
    e.select("event_id", "event_type", "value").repartition(3).write.parquet(f"{base}/in")
    for _ in range(2):
        ingest.process_new_files(spark, f"{base}/in", "event_id long, event_type string, value double", f"{base}/out", f"{base}/state")
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy(F.col("event_type").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT event_type AS grp, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def st02_tumbling_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = ingest.windowed_counts(e, "ts", "event_type", "1 hour", "10 minutes")
    return w.select(F.col("event_type").alias("grp"), F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH r AS (SELECT event_id % 100 AS image, user_id % 5 AS run, value FROM events), l AS (SELECT image AS i, max(run) AS m FROM r GROUP BY image) SELECT image, run, count(*) AS n FROM r JOIN l ON image = i AND run = m GROUP BY image, run""")
def s08_newest_run(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") % 100).alias("image"), (F.col("user_id") % 5).alias("run"), "value")
    return ingest.newest_runs(e).groupBy("image", "run").agg(F.count(F.lit(1)).alias("n"))

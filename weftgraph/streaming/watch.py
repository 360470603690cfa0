"""A stream of file versions as the front end of incremental indexing.

Each micro-batch of (service, relpath, sha256, content) is compared with the current table of
files; only what was added or changed is parsed again. The table is replaced through a pointer
file, so that a reader sees one version or the next and never a mixture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import staging
from weftgraph.operators.dedup import first_rows
from weftgraph.plans.snapshot import publish, read_current

KEYS = ["service", "relpath"]


def apply_batch(spark: SparkSession, root: str, batch: DataFrame, on_stale: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Upsert a batch; a row with null content deletes its file. Returns the files that have to be parsed again."""
    batch = first_rows(batch, KEYS, [-F.col("version")])
    old = read_current(spark, root)
    gone = batch.where("content IS NULL").select(*KEYS)
    new = batch.where("content IS NOT NULL").select(*KEYS, F.sha2("content", 256).alias("sha256"), "content")
    if old is None:
        stale, after = new, new
    else:
        kept = old.join(gone, KEYS, "left_anti")
        changes = staging.delta(kept, new, KEYS, "sha256").where("status IN ('added', 'changed')")
        stale = new.join(changes.select(*KEYS), KEYS, "left_semi")
        after = staging.upsert(kept, new, KEYS)
    version = publish(after, root)
    if on_stale is not None:
        on_stale(stale.withColumn("published", F.lit(version)))
    return stale


def watch(stream: DataFrame, root: str, checkpoint: str, on_stale: Callable[[DataFrame], None] | None = None):
    """Start the stream. ``stream`` has service, relpath, content, version."""
    def each(df: DataFrame, _: int) -> None:
        apply_batch(df.sparkSession, root, df, on_stale)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

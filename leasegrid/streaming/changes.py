"""Keeps a ledger table in step with a stream of dated overrides."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from leasegrid.operators import ledger


def keep_ledger(events: DataFrame, inputs: ledger.Inputs, overrides_path: str, out: str, checkpoint: str) -> StreamingQuery:
    """For each batch of override events, adds them to the table of overrides and writes the ledger of
    the leases they touch under out/batch=N; a batch that runs again replaces its own files."""
    spark = inputs.months.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.parquet(f"{overrides_path}/batch={number}", mode="overwrite")
        known = spark.read.option("basePath", overrides_path).parquet(overrides_path).where(f"batch <= {number}").select(*batch.columns)
        touched = batch.select("lease_id").distinct()
        own = {name: getattr(inputs, name).join(touched, "lease_id", "left_semi") for name in ("leases", "months", "charges", "concessions", "one_time")}
        rows = ledger.ledger(replace(inputs, **own, overrides=known.join(touched, "lease_id", "left_semi")))
        ledger.with_remaining(rows).write.parquet(f"{out}/batch={number}", mode="overwrite")

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Extension: the same rules over a stream of raw applications, one report per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessaryn.operators import report, rules


def validate_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends ``batch_id`` and the rule rows of each micro-batch to ``path``; batches that come twice replace their rows."""

    def one(batch: DataFrame, batch_id: int) -> None:
        rows = report.rule_rows(batch, rules.application_flags("pre"), rules.APPLICATION_RULES, "pre", examples=False)
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()

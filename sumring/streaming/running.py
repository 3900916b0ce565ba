"""Sufficient statistics kept up to date over a stream: ring addition is a grouped sum, so Structured Streaming's own state holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.cofactor import sum_expressions
from ..operators.lineage import shared_path


def running_sums(stream: DataFrame, by: list[str], cont: list[str]) -> DataFrame:
    """n, s_i, q_i_j by key, for output mode update or complete; rows with nulls among the columns are skipped."""
    return stream.dropna(subset=cont).groupBy(*by).agg(*sum_expressions(cont))


def into_memory(sums: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Run over all that is available now, into an in-memory table (for reports of bounded size). Offsets and state are kept in the cluster's
    shared folder, or under ``checkpoint``."""
    checkpoint = checkpoint or shared_path(sums.sparkSession, "stream")
    writer = sums.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start()

"""Row-local steps on a stream: the batch functions, unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Cleaning
from ..operators.cleaning import clean_column
from ..plans.modeling import TopicModel
from ..session import scratch_path


def clean_stream(stream: DataFrame, source: str, target: str = "docs", cfg: Cleaning = Cleaning()) -> DataFrame:
    return clean_column(stream, source, target, cfg).filter(f"{target} <> ''")


def assign_stream(stream: DataFrame, model: TopicModel) -> DataFrame:
    """Topics of newly arriving vectors."""
    return model.transform(stream)


def write_stream(stream: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append to a Parquet folder until the available input is used up."""
    place = checkpoint or scratch_path(stream.sparkSession, "stream")
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", place).trigger(availableNow=True).start(path)

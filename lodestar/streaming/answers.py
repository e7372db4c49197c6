"""Answers that arrive as a stream, parsed and cleaned as they are in a batch.

Each row is handled on its own, so the stream keeps no state and needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from lodestar.operators.answers import cleaned, parse_answers


def write_parsed_answers(answers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append parsed answers of a streaming ``(query_id, content, model, usage)`` to a table."""
    return (
        cleaned(parse_answers(answers))
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )

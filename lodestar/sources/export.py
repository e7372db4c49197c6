"""Results as JSON: files, or an inline link that holds the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_text(record: Column, pretty: bool = False) -> Column:
    """A struct as JSON text; characters beyond ASCII are kept."""
    return F.to_json(record, {"pretty": str(pretty).lower(), "ignoreNullFields": "false"})


def data_link(json: Column) -> Column:
    """JSON text as a base64 data link."""
    # base64() breaks its output into lines of 76 characters; a link has none.
    encoded = F.regexp_replace(F.base64(F.encode(json, "UTF-8")), r"\s", "")
    return F.concat(F.lit("data:file/json;base64,"), encoded)


def export_json(df: DataFrame, path: str) -> None:
    """Write one JSON record per row."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)

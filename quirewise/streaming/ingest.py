"""Tokens of documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quirewise.sources.model import from_documents


def read_documents(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """A stream of the Parquet files that appear in a folder; schema holds doc_id and text."""
    return spark.readStream.schema(schema).parquet(folder)


def append_tokens(documents: DataFrame, folder: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Tokenise what arrives and append it to a folder, once; tokenising keeps no state and takes no exchange, so a batch
    costs what it holds. Ends when all files there are read."""
    out = from_documents(documents).writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return out.options(**options).trigger(availableNow=True).start()

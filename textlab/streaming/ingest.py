"""Analysis at ingest: the same transformation for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from textlab.functions.analysis import REGISTRY, Analyzer, Registry, tokens_of


def ingest_analyze(df: DataFrame, field: str, analyzer: str | Analyzer, target_field: str | None = None, strict: bool = False, registry: Registry = REGISTRY) -> DataFrame:
    """The table with a field's tokens in ``target_field`` (the field itself, unless named).

    A text gives its tokens, an array of texts those of all its texts in order. A null gives
    null, or an error with ``strict``. Other types raise an error at once. No state is kept,
    so that it serves ``readStream`` unchanged.
    """
    if field not in df.columns:
        raise ValueError(f"field [{field}] not found")
    kind = df.schema[field].dataType
    if not (isinstance(kind, T.StringType) or (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType))):
        raise ValueError(f"field [{field}] of type [{kind.simpleString()}] can't be analyzed, it must be a string or an array of strings")
    tokens = tokens_of(df, field, analyzer, registry)
    if strict:
        tokens = F.when(F.col(field).isNull(), F.raise_error(F.lit(f"field [{field}] is null, can't be analyzed")).cast("array<string>")).otherwise(tokens)
    return df.withColumn(target_field or field, tokens)


def ingest_stream(df: DataFrame, path: str, checkpoint: str, field: str, analyzer: str | Analyzer, target_field: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Analyze a stream and append it to a Parquet folder, exactly once by its checkpoint."""
    writer = ingest_analyze(df, field, analyzer, target_field).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

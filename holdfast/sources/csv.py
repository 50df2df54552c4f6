"""CSV in and out with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """Comma-separated, quoted on demand, one header line, blanks trimmed, ``NULL`` and empty read as NULL.

    ``multiline`` accepts line breaks inside quotes; a file is then read by one task, so
    leave it off for large files without such breaks.
    """
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    raw = (
        spark.read.schema(loose)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "NULL")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("multiLine", multiline)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return raw.select(
        *[
            F.when(~F.trim(f.name).isin("", "NULL"), F.trim(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """Write the named columns with a header; other columns of the frame are left out."""
    df.select(*columns).write.mode(mode).option("header", True).option("escape", '"').csv(path)

"""Sources: delimited text, tables, columnar files, records."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: delimiters tried, the first wins a tie
DELIMITERS = (",", ";", "\t", "|")
BOM = "﻿"


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The candidate that occurs most often in the first line; one row reaches the driver."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0].lstrip(BOM) if first else ""
    return max(DELIMITERS, key=line.count) if any(d in line for d in DELIMITERS) else ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Header, quoted fields, any of the delimiters, byte-order mark; rows with another number of fields are skipped.

    All columns are text; :mod:`tidewright.operators.normalize` types them.  Column pruning is off in the reader because
    the length of a row can only be judged when it is parsed whole.
    """
    df = (spark.read.option("header", True).option("sep", sep or sniff_delimiter(spark, path)).option("quote", '"').option("escape", '"')
          .option("mode", "DROPMALFORMED").option("columnPruning", False).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path))
    return df.toDF(*[c.lstrip(BOM).strip() for c in df.columns])


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, read where it is used and never gathered."""
    return spark.table(name)


def read_panel(spark: SparkSession, path: str, segment: Mapping[str, object] | None = None) -> DataFrame:
    """Columnar panel; a segment filter prunes partitions where the folder is partitioned by it, else row groups."""
    df = spark.read.parquet(path)
    for c, v in (segment or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    return df


def from_records(spark: SparkSession, rows: Iterable[Mapping[str, object]], schema=None) -> DataFrame:
    """Records of a request; without a schema the columns are those of all records and types are inferred."""
    rows = list(rows)
    if schema is not None:
        return spark.createDataFrame(rows, schema)
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], names)

"""Small result tables as CSV and Markdown."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles with a fixed number of digits, null and NaN as empty text."""
    out = [F.when(F.col(c).isNull() | F.isnan(c), "").otherwise(F.format_string(f"%.{digits}f", c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(*out)


def write_csv(df: DataFrame, path: str, one: bool = True) -> None:
    """One file for a table that is read by people, or a file per partition for one that isn't."""
    (df.coalesce(1) if one else df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def markdown(df: DataFrame, *order: str) -> Iterator[str]:
    """Lines of a Markdown table in order; the driver holds one partition at a time, and every row comes."""
    yield "| " + " | ".join(df.columns) + " |"
    yield "| " + " | ".join(["---"] * len(df.columns)) + " |"
    for row in rounded(df).orderBy(*order).toLocalIterator():
        yield "| " + " | ".join("" if v is None else str(v) for v in row) + " |"

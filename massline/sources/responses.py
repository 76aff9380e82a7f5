"""Cached model answers: file names carry the keys, texts are parsed once read, and misses go to a pluggable client."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

NAME = r"([^/]+)_([AB])_w(\d+)_sample(\d+)\.txt$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, condition, win, sample, raw of every answer file under the path."""
    x = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("raw"))
    part = lambda i: F.regexp_extract("p", NAME, i)
    return x.where(F.col("p").rlike(NAME)).select(part(1).alias("doc_id"), part(2).alias("condition"), part(3).cast("int").alias("win"), part(4).cast("int").alias("sample"), "raw")


def usage(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, condition, win, sample, usage (map of counts) of every usage file beside the answers: NAME.usage.json."""
    name = NAME.replace(r"\.txt$", r"\.usage\.json$")
    x = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.from_json("value", "map<string,string>").alias("usage"))
    part = lambda i: F.regexp_extract("p", name, i)
    counts = F.transform_values(F.map_filter("usage", lambda k, v: v.rlike("^[0-9]+$")), lambda k, v: v.cast("long"))
    return x.where(F.col("p").rlike(name)).select(part(1).alias("doc_id"), part(2).alias("condition"), part(3).cast("int").alias("win"), part(4).cast("int").alias("sample"), counts.alias("usage"))


def table(spark: SparkSession, path: str) -> DataFrame:
    """A result table as it was written: a header, all columns text, empty fields null."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def complete(wanted: DataFrame, cache: DataFrame, keys: list[str], client: Callable[[], Callable[[str], str]], attempts: int = 2) -> DataFrame:
    """wanted (keys, prompt) -> keys, raw, starts, reason, cached: usable cached answers, and fresh ones for the rest.

    client() is made once per partition and called up to ``attempts`` times for a prompt, until an answer parses.
    Repeating a call is harmless: whoever writes the result keys it by the same columns.
    """
    have = wanted.join(cache.select(*keys, "raw"), keys, "left").withColumn("x", T.parse_starts(F.col("raw")))
    usable = F.col("raw").isNotNull() & F.col("x.reason").isNull()
    kept = have.where(usable).select(*keys, "raw", F.lit(True).alias("cached"))
    missing = have.where(~F.coalesce(usable, F.lit(False))).select(*keys, "prompt")

    def ask(batches: Iterator) -> Iterator:
        import json
        import re

        call = client()
        for b in batches:
            out = []
            for prompt in b["prompt"]:
                raw = None
                for _ in range(attempts):
                    raw = call(prompt)
                    m = re.search(r"\[.*\]", raw, re.S)
                    try:
                        if m and all(isinstance(v, int) and not isinstance(v, bool) or isinstance(v, str) and re.fullmatch(r"\s*[+-]?\d+\s*", v) for v in json.loads(m[0])):
                            break
                    except ValueError:
                        pass
                out.append(raw)
            b = b[keys].copy()
            b["raw"] = out
            yield b

    schema = missing.select(*keys).schema.add("raw", "string")
    fresh = missing.mapInPandas(ask, schema).withColumn("cached", F.lit(False))
    return kept.unionByName(fresh).withColumn("x", T.parse_starts(F.col("raw"))).select(*keys, "raw", "x.starts", "x.reason", "cached")

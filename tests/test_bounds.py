"""Rounding as SQL rounds, and batches of the tokeniser bounded in letters."""

import duckdb
import pyarrow as pa
from massline.functions import text as T
from massline.operators import tokeniser as K
from pyspark.sql import functions as F


def test_rounding_is_that_of_sql(spark):
    xs = [0.0640625, 0.5, -0.25, 1.005, None, 123.45, -0.04, 8.0e7 + 0.35, *[k / 640 for k in range(-3000, 3000)], *[1.7e7 + k / 4000 for k in range(4000)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [tuple(r)[1:] for r in df.select("i", *[T.rounded("x", d).alias(f"r{d}") for d in (1, 3, 4, 6)]).orderBy("i").collect()]
    t = pa.table({"i": list(range(len(xs))), "x": pa.array(xs, pa.float64())})
    assert got == duckdb.connect().execute("select round(x, 1), round(x, 3), round(x, 4), round(x, 6) from t order by i").fetchall()
    assert len(t) == len(got)


def test_the_tokeniser_hands_on_slices(monkeypatch):
    texts = ["s=o (H) [yes].", None, "what§", "", *["one two, three"] * 50, "x " * 3000, "end."]
    whole = [K.attempt(t) for t in texts]
    monkeypatch.setattr(K, "SLICE", 400)
    got = list(K._attempts(iter([pa.array(texts[:20]), pa.array(texts[20:])])))
    assert [x for a in got for x in a.to_pylist()] == whole
    assert len(got) > 10 and all(len(a) == 1 or sum(len(t or "") for t in a.field("items").to_pylist()) < 400 for a in got)


def test_slices_through_spark(spark):
    rows = [(i, None if i % 7 == 0 else "b==itch (H) a-b, " * (i % 40)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(1)
    got = {r.i: r.k for r in df.select("i", F.size(K.items(F.col("t")).getField("items")).alias("k")).collect()}
    assert got == {i: len(K.tokenise(t or "")) for i, t in rows}


def test_quantile_ranges_do_not_depend_on_the_order_of_rows(spark):
    """The ranges are worked out more than once; with an approximate quantile each time may give others, and wrong ranks."""
    import numpy as np
    from massline.operators import quantiles as Q

    df = spark.range(60000).select((F.col("id") % 2).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1000).alias("x")).repartition(7)
    got = Q.quantiles(df, "k", "x", {"a": 0.0, "b": 0.25, "c": 0.75, "d": 1.0})
    assert "percentile_approx" not in got._jdf.queryExecution().analyzed().toString()
    values = df.toPandas()
    for r in got.collect():
        assert np.allclose(r[1:], np.quantile(values.x[values.k == r.k], [0, 0.25, 0.75, 1]), rtol=0, atol=1e-6)

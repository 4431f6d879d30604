"""The linear programme of weights with bounded total variation, as a table of coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def constraints(spark: SparkSession, n: int, k: int) -> DataFrame:
    """(kind, r, col, coeff) for n samples and k components.

    Variables are the weights in order of sample and component, then a bound on
    each step of each weight. Kinds: eq (weights of a sample sum to 1),
    positive, up and down (a step is within its bound), bound (the bounds of a
    component's steps have a limited sum).
    """
    v = spark.range(n).withColumnRenamed("id", "t").crossJoin(spark.range(k).withColumnRenamed("id", "i"))
    v = v.withColumn("g", F.col("t") * k + F.col("i")).withColumn("e", F.col("g") + n * k)
    step = v.where(F.col("t") < n - 1)
    parts = [
        ("eq", v, "t", "g", 1.0), ("positive", v, "g", "g", -1.0), ("positive", step, "e", "e", -1.0),
        ("up", step, "g", f"g + {k}", 1.0), ("up", step, "g", "g", -1.0), ("up", step, "g", "e", -1.0),
        ("down", step, "g", f"g + {k}", -1.0), ("down", step, "g", "g", 1.0), ("down", step, "g", "e", -1.0),
        ("bound", step, "i", "e", 1.0),
    ]
    tables = [rows.select(F.lit(kind).alias("kind"), F.expr(r).alias("r"), F.expr(col).alias("col"), F.lit(x).alias("coeff")) for kind, rows, r, col, x in parts]
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out

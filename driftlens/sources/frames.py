"""Time series as DataFrames: contracts, checks, lags.

A series has series_id LONG, t LONG (the order; gaps do no harm) and x
ARRAY<DOUBLE>; exogenous inputs are u ARRAY<DOUBLE>.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.functions import vec
from driftlens.sources.store import written


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, x, label) of the table embeddings, each vector once."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = F.transform("embedding", lambda v: v.cast("double"))
    return rows.select(F.lit(0).cast("long").alias("series_id"), F.col("vec_id").cast("long").alias("t"), x.alias("x"), "label")


def read_csv_series(spark: SparkSession, path: str, schema: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A CSV file with # comments as one series; t counts rows in order from 0."""
    rows = spark.read.csv(path, schema=schema, comment="#")
    return numbered(rows, order).select(F.lit(0).cast("long").alias("series_id"), "t", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))


def daily_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, gamma): for each day the shares of the event types, in order of type; one series on the simplex."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts IS NOT NULL AND event_type IS NOT NULL")
    counts = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    kinds = [r[0] for r in counts.select("event_type").distinct().orderBy("event_type").collect()]
    each = [F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("n"))), F.lit(0)).cast("double") for k in kinds]
    days = counts.groupBy("day").agg(F.array(*each).alias("n"))
    first = counts.agg(F.min("day")).first()[0]
    t = F.datediff("day", F.lit(first)).cast("long")
    return days.select(F.lit(0).cast("long").alias("series_id"), t.alias("t"), vec.normalised("n").alias("gamma"))


#: Rows of a series that are neighbours and go to one task together, and the most long series that are told apart by a list.
CHUNK, MANY = 1 << 14, 1000


def lagged(df: DataFrame, column: str, lags: Sequence[int], by: str = "auto", series: str = "series_id", order: Sequence[str] = ("t",)) -> DataFrame:
    """df with column_lag1, ...: values that many rows before in the series (null before its start; negative lags lead).

    by="window" sorts each series in one task. by="chunk" numbers all rows in
    order of (series, order) and sorts CHUNK consecutive rows, of whatever
    series, with the few rows before and after them that they look at. by="auto"
    counts rows: series of more than CHUNK go by chunks, the others by windows.
    by="join" joins the series to itself on (series_id, t): t has no gaps then.
    """
    if by not in ("auto", "window", "chunk", "join"):
        raise ValueError(f"lags are taken by auto, window, chunk or join: {by!r}")
    if not lags:
        return df
    if by == "auto":
        large = df.groupBy(series).agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select(series).limit(MANY + 1).collect()
        if not large or len(large) > MANY:
            return lagged(df, column, lags, "chunk" if large else "window", series, order)
        is_large = F.coalesce(F.col(series).isin([r[0] for r in large if r[0] is not None]), F.lit(any(r[0] is None for r in large)))
        parts = [lagged(df.where(is_large), column, lags, "chunk", series, order), lagged(df.where(~is_large), column, lags, "window", series, order)]
        return parts[0].unionByName(parts[1])
    if by == "join":
        for k in lags:
            past = df.select(series, (F.col("t") + k).alias("t"), F.col(column).alias(f"{column}_lag{k}"))
            df = df.join(past, [series, "t"], "left")
        return df
    if by == "window":
        w = Window.partitionBy(series).orderBy(*order)
        return df.withColumns({f"{column}_lag{k}": F.lag(column, k).over(w) for k in lags})
    back, ahead = max(0, *lags), max(0, *(-k for k in lags))
    size, place = max(CHUNK, back, ahead), F.col("_place")
    rows = numbered(df, [series, *order], "_place")
    own = F.floor(place / size)
    # a row is also sent to the chunks whose rows look at it
    to = F.array_distinct(F.array(own, F.floor((place + back) / size), F.floor((place - ahead) / size)))
    rows = rows.withColumn("_own", own).withColumn("_chunk", F.explode(to))
    w = Window.partitionBy("_chunk").orderBy("_place")
    same = lambda k: F.lag(series, k).over(w).eqNullSafe(F.col(series)) & F.lag(F.lit(True), k).over(w).isNotNull()
    out = rows.withColumns({f"{column}_lag{k}": F.when(same(k), F.lag(column, k).over(w)) for k in lags})
    return out.where("_own = _chunk").drop("_own", "_chunk", "_place")


def numbered(df: DataFrame, order: Sequence[str], name: str = "t") -> DataFrame:
    """df with a number from 0 for each row in this order, which must have no ties. Rows are range-partitioned; only the sizes of partitions meet on the driver."""
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ranged.withColumns({"_part": F.shiftright(place, 33), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    starts, at = [], 0
    for part, n in sorted(rows.groupBy("_part").count().collect()):
        starts.append((part, at))
        at += n
    table = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    return rows.join(F.broadcast(table), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def log_difference(df: DataFrame, by: str = "auto") -> DataFrame:
    """First differences of logarithms of x; a series loses its first row."""
    logs = df.withColumn("x", F.transform("x", lambda v: F.log(v)))
    rows = lagged(logs, "x", [1], by).where("x_lag1 IS NOT NULL")
    return rows.withColumn("x", vec.add("x", "x_lag1", -1.0)).drop("x_lag1")


def check_vectors(df: DataFrame, column: str = "x", width: int | None = None) -> tuple[int, int]:
    """(rows, width); raises unless all vectors have one width and only finite values."""
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    size = F.size(column)
    n, least, most, empty, broken = df.agg(F.count("*"), F.min(size), F.max(size), F.count_if(F.col(column).isNull()), F.count_if(bad)).first()
    if not n:
        raise ValueError("there are no rows")
    if empty or broken:
        raise ValueError(f"{column} has null, NaN or infinite values")
    if least != most or width not in (None, least):
        raise ValueError(f"{column} has widths {least} to {most}, not {width or 'one'}")
    return n, least


def check_unit_sums(df: DataFrame, column: str = "gamma", rtol: float = 1e-5, atol: float = 1e-8) -> float:
    """The largest distance of sums from 1; raises where it is not near 0."""
    worst = df.agg(F.max(F.abs(vec.total(column) - 1))).first()[0] or 0.0
    if worst > atol + rtol:
        raise ValueError(f"{column} does not sum to 1: off by {worst}")
    return worst


def check_order(df: DataFrame) -> None:
    """Raises unless t is unique in each series."""
    if not df.groupBy("series_id", "t").count().where("count > 1").isEmpty():
        raise ValueError("t repeats within a series")


def check_positive(**values: float) -> None:
    """Raises unless all are positive integers, or not negative for tolerance."""
    for name, v in values.items():
        if name == "tolerance":
            if not v >= 0:
                raise ValueError(f"tolerance must not be negative: {v}")
        elif not isinstance(v, int) or isinstance(v, bool) or v < 1:
            raise ValueError(f"{name} must be a positive integer: {v}")

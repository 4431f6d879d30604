"""Fitted models on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftlens.operators.markov import KMeansMarkovModel
from driftlens.operators.models import code


def assign(stream: DataFrame, model: KMeansMarkovModel) -> DataFrame:
    """Labels of a stream's rows; row-local, so the batch expression serves as it is."""
    return model.transform(stream)


def encode(stream: DataFrame, states: np.ndarray) -> DataFrame:
    """Convex weights of a stream's rows for fixed states."""
    return code(stream, states)


def counts(stream: DataFrame, time: str, kind: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts of kinds in windows of event time; rows later than `late` are dropped, as the watermark says."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("window"), kind).agg(F.count("*").alias("n"))


def transitions(stream: DataFrame, series: str = "series_id", order: str = "t", label: str = "label") -> DataFrame:
    """(series, cur_state, next_state, n) of each micro-batch; the last label of a series is its state. Labels are strings."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        labels = ([state.get[0]] if state.exists else []) + rows[label].tolist()
        state.update((labels[-1],))
        pairs = pd.DataFrame({"cur_state": labels[:-1], "next_state": labels[1:]}).value_counts().reset_index(name="n")
        pairs.insert(0, series, key[0])
        yield pairs

    ddl = f"{series} long, cur_state string, next_state string, n long"
    return stream.select(series, order, label).groupBy(series).applyInPandasWithState(step, ddl, "last string", "append", GroupStateTimeout.NoTimeout)

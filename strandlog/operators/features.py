"""Time-series features over windows of rows in a global order.

Input columns: idx (total order), t (microseconds), v. Defined cases: the first row has no difference; null values make no
change; the last window may be short; an empty series gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.operators.ordered import numbered, over_preceding


def changes(series: DataFrame, threshold: float) -> DataFrame:
    """Adds ``changed``: whether the value differs from the one before by more than the threshold; and ``rn``."""
    blocks, w = over_preceding(numbered(series, ["idx"]), 1)
    changed = F.coalesce(F.abs(F.col("v") - F.lag("v").over(w)) > threshold, F.lit(False))
    return blocks.withColumn("changed", changed).filter("_own").drop("_own", "_block")


def row_windows(series: DataFrame, rows: int, threshold: float) -> DataFrame:
    """Per window of ``rows`` rows: win, read_time (time of its last row), write_counts (its changes)."""
    win = F.floor(F.col("rn") / F.lit(rows)).cast("long")
    return changes(series, threshold).withColumn("win", win).groupBy("win").agg(F.max_by("t", "rn").alias("read_time"), F.count_if("changed").alias("write_counts"))


def with_period(windows: DataFrame) -> DataFrame:
    """Adds ``period``: time since the window before, 0 for the first."""
    blocks, w = over_preceding(windows.withColumn("rn", F.col("win")), 1)
    return blocks.withColumn("period", F.coalesce(F.col("read_time") - F.lag("read_time").over(w), F.lit(0))).filter("_own").drop("_own", "_block", "rn")


def sequences(series: DataFrame, length: int) -> DataFrame:
    """For each row after the first ``length``: the values before it (``seq``) and its own (``target``)."""
    blocks, w = over_preceding(numbered(series, ["idx"]), length)
    seq = F.collect_list("v").over(w.rowsBetween(-length, -1))
    return blocks.withColumn("seq", seq).filter(F.col("_own") & (F.size("seq") == length)).select("idx", "seq", F.col("v").alias("target"))


def accuracy(pred: Column, target: Column) -> Column:
    """Percent of rows whose prediction rounds (half to even) to the target's rounding."""
    return F.lit(100.0) * F.count_if(F.bround(pred, 0) == F.bround(target, 0)) / F.count("*")


def split(df: DataFrame, ident: Column, train_percent: int = 80) -> DataFrame:
    """Adds ``train``: a split that depends on the row's id only."""
    return df.withColumn("train", F.pmod(F.xxhash64(ident), F.lit(100)) < train_percent)


def lstm_scores(seqs: DataFrame, weights: dict[str, np.ndarray], seq: str = "seq", ident: str = "idx") -> DataFrame:
    """(ident, score) by a one-layer LSTM with a linear output, on whole batches of sequences of numbers or of arrays of k numbers.

    ``weights``: wx (4h, k), wh (4h, h), b (4h), out (h), bias; gates in the order input, forget, cell, output.
    """
    kind = seqs.schema[ident].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wx, wh, b = weights["wx"], weights["wh"], weights["b"]
        n = wh.shape[1]
        act = lambda z: 1.0 / (1.0 + np.exp(-z))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array([[np.ravel(step) for step in s] for s in pdf[seq]], dtype=float)
            h, c = np.zeros((len(x), n)), np.zeros((len(x), n))
            for step in range(x.shape[1]):
                z = x[:, step] @ wx.T + h @ wh.T + b
                i, f, g, o = act(z[:, :n]), act(z[:, n : 2 * n]), np.tanh(z[:, 2 * n : 3 * n]), act(z[:, 3 * n :])
                c = f * c + i * g
                h = o * np.tanh(c)
            yield pd.DataFrame({ident: pdf[ident], "score": h @ weights["out"] + weights["bias"]})

    return seqs.select(ident, seq).mapInPandas(score, f"{ident} {kind}, score double")



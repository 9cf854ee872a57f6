"""Rows that share a key, met as runs of equal keys in sorted partitions.

A shuffle by key and a sort bring equal keys together; Python then streams over
the partition and looks only at runs with two or more different values. Unlike a
grouped call, this costs nothing for the many keys that stand alone, and unlike
a self-join it never lays out all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The same rows, cut so that no run of equal keys is split between two frames."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        if held and keys[-1] == held[-1][key].iat[-1]:
            if keys[0] == keys[-1]:
                held.append(batch)
                continue
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        held.append(batch.iloc[:last])
        done = pd.concat(held, ignore_index=True)
        if len(done):
            yield done
        held = [batch.iloc[last:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def shared(pairs: DataFrame, each: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """`each(keys, values, first)` over the (key, value) rows of keys that have two or more different values.

    `keys` and `values` are sorted and without repeats; `first` has the place of each key's first row and the end.
    """
    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_runs(batches, "key"):
            keys, values = frame["key"].to_numpy(), frame["value"].to_numpy()
            if len(keys) < 2:
                continue
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
            keys, values = keys[new], values[new]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            many = np.diff(np.append(first, len(keys))) > 1
            if not many.any():
                continue
            keep = np.repeat(many, np.diff(np.append(first, len(keys))))
            keys, values = keys[keep], values[keep]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            yield each(keys, values, first)

    dealt = pairs.select(F.col("key"), F.col("value")).repartition("key").sortWithinPartitions("key", "value")
    return dealt.mapInPandas(stream, schema)


def collisions(pairs: DataFrame) -> DataFrame:
    """The (key, value) rows, once each, of keys that have two or more different values."""
    return shared(pairs, lambda keys, values, first: pd.DataFrame({"key": keys, "value": values}), "key long, value long")

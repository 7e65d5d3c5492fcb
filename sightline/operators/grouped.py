"""Functions over small groups, read as a sorted stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, key: str, order: list[str], run: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """run over the columns of each group of `key`, in order, as arrays; the results one after another.

    Groups are dealt by key and sorted in their partitions. A task holds one Arrow batch and the group at its
    end, so many small groups cost no frame each. A group must fit into a task's memory.
    """
    names = df.columns
    out_names = [f.split()[0] for f in schema.split(", ")]

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the open group, a part a batch
        for pdf in frames:
            if not len(pdf):
                continue
            keys = pdf[key].to_numpy()
            if held and keys[-1] == held[0][key].iloc[0]:
                held.append(pdf)  # nothing is joined while one group fills whole batches
                continue
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if held or last:
                yield over(pd.concat([*held, pdf.iloc[:last]], ignore_index=True))
            held = [pdf.iloc[last:]]
        if held:
            yield over(pd.concat(held, ignore_index=True))

    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = {c: pdf[c].to_numpy() for c in names}
        keys = columns[key]
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        parts = [run({c: v[a:b] for c, v in columns.items()}) for a, b in zip(cuts, cuts[1:])]
        return pd.DataFrame({n: np.concatenate([p[n] for p in parts]) for n in out_names})

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(stream, schema)

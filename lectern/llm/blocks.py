"""What joins that find candidates in groups share: groups dealt to blocks, one unit of work for each pair of blocks, and links within a unit."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import stored


def linked_roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..size-1 and edges (a, b): the smallest node that each hangs together with."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def roots(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of these nodes and links (a, b) between rows: the smallest node that each hangs together with."""
    order = np.argsort(node, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return node[order[linked_roots(len(node), place[a], place[b])[place]]]


#: Groups of up to so many rows are handled many at a time, where there is a form for that.
FEW = 64


def pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one group, for groups of these sizes that stand one after the other."""
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.arange(len(begin))
    many = np.repeat(np.cumsum(sizes), sizes) - left - 1  # rows of the group behind this one
    a = np.repeat(left, many)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)


def by_group(keys: list[str], unit: Callable[[pd.DataFrame], pd.DataFrame | None], few: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame | None] | None = None):
    """A mapInPandas function for rows sorted by keys: unit gets the rows of each key once, all together.

    few: gets the rows of all small groups that are one block, with the groups' sizes, instead.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not len(batch):
                continue
            if batch is not None and held and (batch[keys].iloc[-1] == held[-1][keys].iloc[-1]).all():
                held.append(batch)  # all of one key so far: wait for its end
                continue
            part = pd.concat([*held, *([] if batch is None else [batch])], ignore_index=True) if held or batch is not None else None
            if part is None:
                continue
            k = part[keys].to_numpy()
            cuts = np.nonzero((k[1:] != k[:-1]).any(1))[0] + 1
            ends = np.array([*cuts, *([len(part)] if batch is None else [])], np.int64)
            starts, out = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)], []
            sizes = ends - starts
            small = np.zeros(len(ends), bool)
            if few is not None and len(ends):
                small = (sizes <= FEW) & (part["i"].to_numpy()[starts] == part["j"].to_numpy()[starts])
                some = small & (sizes > 1)
                if some.any() and (done := few(part[np.repeat(np.append(some, False), np.append(sizes, len(part) - ends[-1]))], sizes[some])) is not None:
                    out.append(done)
            for at, end in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
                if end - at > 1 and (done := unit(part.iloc[at:end])) is not None:
                    out.append(done)
            held = [] if batch is None else [part.iloc[int(ends[-1]) if len(ends) else 0 :]]
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def sides(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows to compare with each other: the two blocks of this unit, or all with all."""
    i, j = part["i"].iat[0], part["j"].iat[0]
    if i == j:
        return np.arange(len(part)), np.arange(len(part)), True
    block = part["block"].to_numpy()
    return np.nonzero(block == i)[0], np.nonzero(block == j)[0], False


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows with `blocks` to one row per unit of work: block, i and j (two blocks that meet)."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks").repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "node")


def once(rows: DataFrame, key: str, least: Column) -> DataFrame:
    """rows with a key, one for each: of rows that repeat one, that of the smallest `least` (a struct, never null)."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    named = rows.filter(F.col(f"`{key}`").isNotNull())
    repeated = stored(named.groupBy(F.col(f"`{key}`").alias("__key")).count().filter("count > 1").select("__key"), "repeated")
    on = F.col(f"`{key}`") == F.col("__key")
    again = named.join(repeated, on, "left_semi").select(F.col(f"`{key}`").alias("__key"), least.alias("__least"), F.struct(*columns).alias("__row"))
    again = again.groupBy("__key").agg(F.min_by("__row", "__least").alias("__row")).select("__row.*")
    return named.join(repeated, on, "left_anti").select(*columns).unionByName(again)

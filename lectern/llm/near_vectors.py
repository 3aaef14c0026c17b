"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A hash rotates a unit vector by three rounds of random signs and the fast Hadamard transform and takes the coordinate
of largest magnitude with its sign. ``hashes`` of them make a bucket of one table; besides its own bucket a vector is
put into the next likeliest ones (``PROBES`` in all), and vectors meet where they share any bucket of any table. The
number of hashes follows the number of vectors, which keeps buckets short; the number of tables is set so that a pair
just at the threshold meets with the probability ``RECALL``, measured on random pairs at exactly that angle.

What moves to a bucket is a node's id and a sketch of ``SKETCH`` signs of random projections; whose sketches are as near as those of a
pair at the threshold (within ``DOUBT`` standard deviations) may be linked, and only who hangs together with whom goes on. So
each vector comes to lie in one group of candidates and is moved there once, and all pairs of the group are verified in double precision.

Equal vectors are one node that carries their number. Buckets and groups of more than ``BLOCK`` nodes are dealt to blocks, and each pair
of blocks is one unit of work, so that no unit holds more than 2 * BLOCK nodes. Out of a unit come sums, never pairs: for each node the
vectors it is linked with and the smallest node it hangs together with there.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do rows
without an id; vectors of different lengths link with nothing of the other length; rows that repeat an id are one vector, the least of
those that can link, and each has its result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import drop_stored, stored
from lectern.llm.blocks import by_group, dealt, once, pairs_within, roots, sides
from lectern.llm.components import connected_components
from lectern.session import ship_package

THRESHOLD = 0.95
PROBES = 4
RECALL = 0.9999
BLOCK = 2048
SEED = 20240613
SKETCH = 128
DOUBT = 5.0


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform of the last axis, whose length is a power of two."""
    n, h = x.shape[-1], 1
    while h < n:
        pairs = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(*x.shape[:-1], n)
        h *= 2
    return x / math.sqrt(n)


def bucket_codes(x: np.ndarray, hashes: int, tables: int, probes: int) -> np.ndarray:
    """int32 codes [rows, tables, probes] of unit vectors; equal codes mean the same bucket of the same table."""
    width = max(2, 1 << (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    top = min(4, width)
    choices = np.array(list(itertools.product(range(top), repeat=hashes)))
    out = np.empty((len(x), tables, probes), np.int32)
    for t in range(tables):
        signs = np.random.default_rng([SEED, t, width]).choice([-1.0, 1.0], size=(hashes, 3, width))
        sides, costs = [], []
        for k in range(hashes):
            y = x
            for r in range(3):
                y = hadamard(y * signs[k, r])
            order = np.argpartition(-np.abs(y), top - 1, axis=1)[:, :top]
            value = np.take_along_axis(y, order, 1)
            by_size = np.argsort(-np.abs(value), axis=1, kind="stable")
            order, value = np.take_along_axis(order, by_size, 1), np.take_along_axis(value, by_size, 1)
            sides.append(order * 2 + (value < 0))
            costs.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
        cost = sum(costs[k][:, choices[:, k]] for k in range(hashes))
        best = choices[np.argsort(cost, axis=1, kind="stable")[:, :probes]]
        code = np.full(best.shape[:2], t + 1, np.uint64)
        for k in range(hashes):
            code = code * np.uint64(2 * width) + np.take_along_axis(sides[k], best[:, :, k], 1).astype(np.uint64)
        code = (code ^ np.uint64(width)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, t, : code.shape[1]] = (code >> np.uint64(32)).astype(np.uint32).view(np.int32)
        if code.shape[1] < probes:  # fewer buckets than probes: the last is named again
            out[:, t, code.shape[1] :] = out[:, t, code.shape[1] - 1 : code.shape[1]]
    return out


def plan_tables(n: int, dim: int, threshold: float, probes: int = PROBES, recall: float = RECALL) -> tuple[int, int]:
    """(hashes per bucket, tables) for n vectors: short buckets, and pairs at the threshold meet with probability recall."""
    width = max(2, 1 << (dim - 1).bit_length())
    hashes = max(2, math.ceil(math.log(max(n, 1) / 4096) / math.log(2 * width))) if n > 4096 else 2
    rng = np.random.default_rng(SEED)
    a, b = rng.normal(size=(2, 4000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b
    x, y = bucket_codes(a, hashes, 1, probes)[:, 0], bucket_codes(b, hashes, 1, probes)[:, 0]
    meets = (x[:, :, None] == y[:, None, :]).any((1, 2)).mean()
    return hashes, max(2, math.ceil(math.log(1 - recall) / math.log(1 - min(max(meets, 0.02), 0.98))))


def _matrix(blobs: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sketches(x: np.ndarray) -> np.ndarray:
    """int64 [rows, SKETCH / 64]: signs of projections on directions that depend on the number of components only."""
    directions = np.random.default_rng([SEED, x.shape[1]]).normal(size=(x.shape[1], SKETCH))
    return np.packbits(x @ directions > 0, axis=1).view(np.int64)


def _hashed(plans: dict[int, tuple[int, int]], kind: str):
    """Rows of (node, dim, vec) to one row per bucket: (bucket, node, s0, s1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                hashes, tables = plans[int(dim)]
                for at in range(0, len(part), 1024):
                    some = part.iloc[at : at + 1024]
                    x = _matrix([np.asarray(v, kind).tobytes() for v in some["vec"]], kind)
                    codes = bucket_codes(x, hashes, tables, PROBES).reshape(len(some), -1)
                    codes.sort(axis=1)
                    first = np.ones(codes.shape, bool)
                    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
                    row, col = np.nonzero(first)
                    sketch = sketches(x)[row]
                    yield pd.DataFrame({"bucket": codes[row, col].astype(np.int64) | (np.int64(dim) << np.int64(32)), "node": some["node"].to_numpy()[row], "s0": sketch[:, 0], "s1": sketch[:, 1]})

    return run


def _hang_together(part: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> pd.DataFrame | None:
    node = part["node"].to_numpy()
    root = roots(node, a, b)
    some = root != node
    return pd.DataFrame({"a": node[some], "b": root[some]}) if some.any() else None


def _may_link(threshold: float):
    """A bucket's rows (node, s0, s1) to (a, b): who hangs together there, by sketches; a form for one bucket, and one for many small ones."""
    share = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    most = SKETCH * share + DOUBT * math.sqrt(SKETCH * share * (1 - share)) + 1
    apart = lambda s, t: np.bitwise_count(s[..., 0] ^ t[..., 0]) + np.bitwise_count(s[..., 1] ^ t[..., 1])
    sketch = lambda part: np.ascontiguousarray(part[["s0", "s1"]].to_numpy()).view(np.uint64)

    def unit(part: pd.DataFrame) -> pd.DataFrame | None:
        s = sketch(part)
        left, right, _ = sides(part)
        a, b = [], []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            x, y = np.nonzero(apart(s[rows][:, None], s[right][None]) <= most)
            a.append(rows[x])
            b.append(right[y])
        return _hang_together(part, np.concatenate(a), np.concatenate(b))

    def few(part: pd.DataFrame, sizes: np.ndarray) -> pd.DataFrame | None:
        s = sketch(part)
        a, b = pairs_within(sizes)
        near = apart(s[a], s[b]) <= most
        return _hang_together(part, a[near], b[near])

    return unit, few


def _verify(threshold: float, kind: str):
    """Rows (node, n, vec) of a group to (node, links, root): exact links of each node here."""

    def unit(part: pd.DataFrame) -> pd.DataFrame | None:
        x = _matrix([np.asarray(v, kind).tobytes() for v in part["vec"]], kind)
        node, n = part["node"].to_numpy(), part["n"].to_numpy()
        left, right, same = sides(part)
        near = x[left] @ x[right].T >= threshold
        if same:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        if not len(a):
            return None
        a, b = left[a], right[b]
        links = np.bincount(a, n[b], len(x)) + np.bincount(b, n[a], len(x))
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "root": roots(node, a, b)[some]})

    return unit


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept."""
    ship_package(vectors.sparkSession)
    kind, code = ("<f8", "double") if "double" in vectors.schema["embedding"].dataType.simpleString() else ("<f4", "float")
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    named = once(given, "vec_id", F.struct(~F.coalesce(fine, F.lit(False)), e)).filter(fine)
    named = named.select("vec_id", F.xxhash64("embedding").alias("k1"), F.hash("embedding").alias("k2"), "embedding")
    nodes = named.groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("embedding").alias("vec"))
    nodes = stored(nodes.withColumn("dim", F.size("vec")).withColumn("vec", F.col("vec").cast(f"array<{code}>")), "vectors")
    plans = {r["dim"]: plan_tables(r["c"], r["dim"], threshold) for r in nodes.groupBy("dim").agg(F.count("*").alias("c")).collect()}

    # who meets whom in a bucket, and may be linked by the sketches
    met = stored(nodes.select("node", "dim", "vec").mapInPandas(_hashed(plans, kind), "bucket long, node long, s0 long, s1 long"), "buckets")
    crowded = met.groupBy("bucket").count().filter(F.col("count") > BLOCK)
    crowded = stored(crowded.select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "crowded")
    rows = met.join(crowded, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    maybe = stored(dealt(rows, "bucket").mapInPandas(by_group(["bucket", "i", "j"], *_may_link(threshold)), "a long, b long").distinct(), "candidates")
    drop_stored(met)
    groups = stored(connected_components(maybe), "groups")

    # verification within the groups
    picked = nodes.select("node", "n", "vec").join(groups.select("node", F.col("component").alias("group")), "node")
    span = groups.groupBy(F.col("component").alias("group")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    found = dealt(picked.join(span, "group"), "group").mapInPandas(by_group(["group", "i", "j"], _verify(threshold, kind)), "node long, links long, root long")
    found = stored(found, "links")
    for done in (crowded, maybe, groups):
        drop_stored(done)

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("k1", "k2", "node", "n").join(links, "node", "left").join(parts, "node", "left")
    known = known.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    by_id = named.select("vec_id", "k1", "k2").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    out = vectors.select(F.col("vec_id").alias("__id"), F.col("vec_id").cast("long").alias("vec_id")).join(by_id, "vec_id", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select(F.col("__id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))

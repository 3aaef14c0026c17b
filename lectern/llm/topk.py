"""Exact top-k search by inner product: ball-tree branch and bound per shard, with the current kth score shared between rounds.

Vectors are dealt to cells by the nearest of at most ``CELLS`` pivots (cluster means of a bounded sample of ``PIVOT_ROWS`` vectors; every
vector is dealt, wherever they lie), and a cell to shards of about ``SHARD`` rows. A shard is cut into a tree of balls by its widest
direction. For a query q, no row of a ball with centre c and radius r scores above q.c + |q| r: a cell's ball tells which queries its
shards are sent, and in a shard a block of queries goes through the tree with those that can still gain from each ball, the most
promising balls first, and drops a query where the bound falls below its current kth score.

Queries go out in rounds, each to the shards next in the order of their bounds (``ROUNDS`` says how many). After every round, the kth score
of a query over all that has been searched is shared: it starts the search of the next shards, and shards whose bound is below it are not
sent the query any more. Balls whose bound equals the kth score are still searched, as ties go to the smaller id. A task builds the tree
of its shard once and streams its queries through it, so it holds a shard and one batch of queries.

Components become floor(256 x). Where products of whole numbers are exact in doubles, scores are matrix products; vectors with larger components
(they are in shards of their own) are multiplied as whole numbers of any size. Defined results: vectors that are null or hold null or
non-finite components take no part, nor do rows without an id; only vectors of one length are compared, empty ones score 0; a score
beyond 64 bits counts as the last one that fits; rows that repeat an id are candidates each, but never for a query of the same id; a query
row that is repeated is answered once per row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm._shared import drop_stored, stored
from lectern.session import ship_package

K = 5
SHARD = 16_384
CELLS = 256
PIVOT_ROWS = 4096
#: Shards that a query has been sent to after each round; the last round takes all others.
ROUNDS = (1, 8, None)
QUERY_BLOCK = 512
LEAF = 96
#: Bounds are floats; they are widened by this share of their terms so that rounding never hides a row.
SLACK = 1e-9
LOW, HIGH = -(2**63) + 1, 2**63 - 1


class BallTree:
    """Balls over the rows of x: nodes hold start, end (in `order`), centre, radius and their two children (or -1)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int]] = []
        centres, radii = [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            at = len(self.spans)
            if parent >= 0:
                self.children[parent] = (at, self.children[parent][1]) if side == 0 else (self.children[parent][0], at)
            rows = x[self.order[start:end]]
            centre = rows.mean(axis=0)
            radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
            self.spans.append((start, end))
            self.children.append((-1, -1))
            centres.append(centre)
            radii.append(radius)
            if end - start > leaf and radius > 0:
                far = rows[np.argmax(((rows - centre) ** 2).sum(axis=1))]
                other = rows[np.argmax(((rows - far) ** 2).sum(axis=1))]
                half = (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(rows @ (far - other), half)]
                todo += [(start, start + half, at, 0), (start + half, end, at, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)


class Shard:
    """Rows of one shard with their tree; x: scaled components, whole numbers as doubles (or, large, as Python's)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int | None = None):
        self.ids, self.x = ids, x
        with np.errstate(all="ignore"):
            self.tree = BallTree(x.astype(np.float64), leaf or LEAF)

    def search(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, id, score) of each query's k best rows that score at least floor, the smaller id first among ties."""
        tree, ids = self.tree, self.ids
        whole = self.x.dtype == object or q.dtype == object
        x, exact = (self.x.astype(object), q.astype(object)) if whole else (self.x, q)
        with np.errstate(all="ignore"):
            qf = q.astype(np.float64)
            norms = np.sqrt((qf**2).sum(axis=1))
            reach = norms[:, None] * (np.sqrt((tree.centres**2).sum(axis=1)) + tree.radii)[None, :]
            bounds = qf @ tree.centres.T + norms[:, None] * tree.radii[None, :] + SLACK * reach + 1e-6
            bounds[~np.isfinite(bounds)] = np.inf
        best_score = np.full((len(q), k), LOW - 1)
        best_id = np.full((len(q), k), np.iinfo(np.int64).max)
        kth = floor.copy()  # LOW - 1: none so far
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, who = todo.pop()
            who = who[bounds[who, node] >= kth[who]]
            if not len(who):
                continue
            left, right = tree.children[node]
            if left >= 0:
                first, second = (right, left) if bounds[who, right].sum() > bounds[who, left].sum() else (left, right)
                todo += [(second, who), (first, who)]  # the last is searched first
                continue
            start, end = tree.spans[node]
            for at in range(start, end, 4096):
                rows = tree.order[at : min(end, at + 4096)]
                score = np.clip(exact[who] @ x[rows].T, LOW, HIGH).astype(np.int64)
                score[q_ids[who][:, None] == ids[rows][None, :]] = LOW - 1
                some = np.nonzero((score >= kth[who][:, None]).any(axis=1))[0]
                if not len(some):
                    continue
                w = who[some]
                all_score = np.concatenate([best_score[w], score[some]], axis=1)
                all_id = np.concatenate([best_id[w], np.broadcast_to(ids[rows], (len(w), len(rows)))], axis=1)
                order = np.lexsort((all_id, ~all_score), axis=1)[:, :k]  # ~: the largest first, without overflow
                best_score[w], best_id[w] = np.take_along_axis(all_score, order, 1), np.take_along_axis(all_id, order, 1)
                kth[w] = np.maximum(kth[w], best_score[w, -1])
        row, col = np.nonzero(best_score > LOW - 1)
        return row, best_id[row, col], best_score[row, col]


def scaled(x: np.ndarray, large: bool) -> np.ndarray:
    """floor(256 x) of doubles: whole numbers as doubles, or as Python's where they are large."""
    if not large:
        return np.floor(256.0 * x)
    return np.array([[math.floor(256.0 * v) if abs(v) < 2.0**900 else 256 * int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _matrix(blobs: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), dim)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as bytes of doubles; large: products of their scaled components may not be exact in doubles."""
    for batch in batches:
        x = [np.asarray(v, "<f8") for v in batch["embedding"]]
        dim = np.array([len(v) for v in x], np.int32)
        most = np.array([np.abs(v).max(initial=0.0) for v in x])
        large = most > np.sqrt(2.0**52 / np.maximum(dim, 1)) / 256 - 1
        yield pd.DataFrame({"id": batch["id"], "asked": batch["asked"], "dim": dim, "large": large, "x": [v.tobytes() for v in x]})


def _pivots(x: np.ndarray, cells: int) -> np.ndarray:
    """Means of clusters of some scaled vectors, in doubles."""
    pivots = x[np.random.default_rng(3).choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(8):
        near = _nearest(x, pivots)[0]
        for c in range(len(pivots)):
            if (near == c).any():
                pivots[c] = x[near == c].mean(axis=0)
    return pivots


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest pivot, its distance) of each vector."""
    cell = np.argmin((pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T, axis=1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))


def _cell(pivots: dict[tuple[int, bool], np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (dim, large), part in batch.groupby(["dim", "large"]):
                with np.errstate(all="ignore"):
                    cell, far = _nearest(np.floor(256.0 * _matrix(part["x"], dim)), pivots[int(dim), bool(large)])
                yield part.assign(cell=cell.astype(np.int32), far=np.where(np.isfinite(far), far, np.inf))

    return run


def _send(cells: dict[int, list[tuple[bool, int, np.ndarray, float, int]]], begin: int, end: int | None):
    """Queries to the shards that are begin-th to end-th by their bounds and can hold a score of at least the kth; cells by dim: (large, cell, centre, radius, shards)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                near = cells[int(dim)]
                shards = np.array([n for *_, n in near])
                for at in range(0, len(part), QUERY_BLOCK):
                    some = part.iloc[at : at + QUERY_BLOCK]
                    with np.errstate(all="ignore"):
                        q = np.floor(256.0 * _matrix(some["x"], dim))
                        norm = np.sqrt((q**2).sum(axis=1))
                        centres, radius = np.array([c for _, _, c, _, _ in near]).reshape(len(near), dim), np.array([r for *_, r, _ in near])
                        bound = q @ centres.T + norm[:, None] * (radius + SLACK * (np.sqrt((centres**2).sum(axis=1)) + radius)) + 1e-6
                        bound[~np.isfinite(bound)] = np.inf
                    order = np.argsort(-bound, axis=1, kind="stable")
                    before = np.cumsum(shards[order], axis=1) - shards[order]  # shards of more promising cells
                    row, col = np.nonzero(bound >= some["kth"].to_numpy()[:, None])
                    place = np.empty_like(order)
                    np.put_along_axis(place, order, before, axis=1)
                    many = shards[col]
                    row, col = np.repeat(row, many), np.repeat(col, many)
                    salt = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    nth = place[row, col] + salt
                    live = (nth >= begin) & (nth < (end or np.inf))
                    row, col, salt = row[live], col[live], salt[live]
                    picked = some.iloc[row]
                    yield pd.DataFrame({
                        "dim": picked["dim"], "shard_large": np.array([n[0] for n in near], bool)[col], "cell": np.array([n[1] for n in near], np.int32)[col], "salt": salt.astype(np.int32),
                        "query": picked["query"], "id": picked["id"], "large": picked["large"], "x": picked["x"], "kth": picked["kth"],
                    })

    return run


_UNIT = ["dim", "shard_large", "cell", "salt"]


def _search(k: int):
    """Rows sorted by shard, a shard's vectors (query -1) before its queries, to (query, id, score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, held, shard = None, [], None
        for batch in batches:
            keys = batch[_UNIT].to_numpy()
            cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(batch)]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                part, key = batch.iloc[a:b], tuple(keys[a])
                if key != unit:
                    unit, held, shard = key, [], None
                vectors, queries = part[part["query"] < 0], part[part["query"] >= 0]
                if len(vectors):
                    held.append((vectors["id"].to_numpy(np.int64), _matrix(vectors["x"], key[0])))
                if not len(queries) or not held:
                    continue
                if shard is None:
                    shard = Shard(np.concatenate([i for i, _ in held]), scaled(np.concatenate([x for _, x in held]), bool(key[1])))
                    held = held[:1]
                for large, some in queries.groupby("large"):
                    for at in range(0, len(some), QUERY_BLOCK):
                        block = some.iloc[at : at + QUERY_BLOCK]
                        row, found, score = shard.search(block["id"].to_numpy(np.int64), scaled(_matrix(block["x"], key[0]), bool(large)), block["kth"].to_numpy(np.int64), k)
                        yield pd.DataFrame({"query": block["query"].to_numpy(np.int64)[row], "id": found, "score": score})

    return run


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of vectors (vec_id, embedding) where is_query holds, its k best others."""
    spark = vectors.sparkSession
    ship_package(spark)
    e = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = F.coalesce(is_query, F.lit(False))
    rows = vectors.filter(fine).select(F.col("vec_id").cast("long").alias("id"), asked.alias("asked"), e.cast("array<double>").alias("embedding"))
    packed = stored(rows.mapInPandas(_packed, "id long, asked boolean, dim int, large boolean, x binary"), "topk-rows")

    # cells, and shards of them
    pivots = {}
    for r in packed.groupBy("dim", "large").agg(F.count("*").alias("n")).collect():  # one row for each length of vectors
        some = packed.filter((F.col("dim") == r["dim"]) & (F.col("large") == r["large"])).orderBy(F.xxhash64("id", "x"), "id", "x").limit(PIVOT_ROWS).select("x").toPandas()["x"]
        with np.errstate(all="ignore"):
            pivots[r["dim"], r["large"]] = _pivots(np.floor(256.0 * _matrix(some, r["dim"])), 1 if r["large"] else min(CELLS, math.ceil(r["n"] / SHARD)))
    schema = "id long, asked boolean, dim int, large boolean, x binary, cell int, far double"
    dealt = stored(packed.mapInPandas(_cell(pivots), schema), "topk-cells")
    drop_stored(packed)
    cells: dict[int, list[tuple[bool, int, np.ndarray, float, int]]] = {}
    for r in dealt.groupBy("dim", "large", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).orderBy("dim", "large", "cell").collect():  # at most CELLS for each length
        cells.setdefault(r["dim"], []).append((r["large"], r["cell"], pivots[r["dim"], r["large"]][r["cell"]], r["far"], math.ceil(r["n"] / SHARD)))
    sizes = spark.createDataFrame([(d, large, c, n) for d, near in cells.items() for large, c, _, _, n in near], "dim int, large boolean, cell int, shards int")
    # dealt by content and place too, should one id be repeated
    salt = F.pmod(F.xxhash64("id", "x", F.monotonically_increasing_id()), F.col("shards")).cast("int").alias("salt")
    shards = dealt.join(F.broadcast(sizes), ["dim", "large", "cell"])
    # a query's number is 0 or more
    shards = stored(shards.select("dim", F.col("large").alias("shard_large"), "cell", salt, F.lit(-1).cast("long").alias("query"), "id", "large", "x", F.lit(LOW - 1).alias("kth")), "topk-shards")
    queries = stored(dealt.filter("asked").select(F.monotonically_increasing_id().alias("query"), "id", "dim", "large", "x"), "topk-queries")
    drop_stored(dealt)

    found, best, begin = None, W.partitionBy("query").orderBy(F.desc("score"), "id"), 0
    most = max((sum(n for *_, n in near) for near in cells.values()), default=0)
    for end in ROUNDS:
        if begin and begin >= most:
            break
        asking = queries.withColumn("kth", F.lit(LOW - 1))
        if found is not None:
            kth = found.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
            asking = queries.join(kth, "query", "left").select(*queries.columns, F.coalesce("floor", F.lit(LOW - 1)).alias("kth"))
        sent = asking.mapInPandas(_send(cells, begin, end), "dim int, shard_large boolean, cell int, salt int, query long, id long, large boolean, x binary, kth long")
        met = shards.unionByName(sent).repartition(*_UNIT).sortWithinPartitions(*_UNIT, "query")
        new = met.mapInPandas(_search(k), "query long, id long, score long")
        both = new if found is None else found.unionByName(new)
        before, found = found, stored(both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank"), "topk-found")
        if before is not None:
            drop_stored(before)
        begin = end
    top = found.withColumn("rank", F.row_number().over(best))
    return top.join(queries.select("query", F.col("id").alias("query_id")), "query").select("query_id", "rank", F.col("id").alias("vec_id"), "score")


#: DuckDB's form for whole numbers of queries: rows whose id is divisible by 50, the 5 best others.
TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0 AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

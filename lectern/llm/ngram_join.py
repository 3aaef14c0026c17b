"""Similarity join of documents on word n-grams: MinHash LSH forest, then exact verification.

A document's signature is ``TREES`` labels of ``DEPTH`` minimum hashes. Each tree is the trie of its sorted labels. Documents meet
at the longest prefix that their labels share: first those of one whole label, then prefixes are shortened value by value, and at
every node of the trie those that come together there are compared by their signatures (alike within ``DOUBT`` standard deviations).
Shortening ends at a node whose documents hang together already, and everywhere at the length where a pair just at the
threshold has met in some tree with probability ``RECALL``; the subtrees below prefixes of that length are the units of work. Only who
hangs together with whom goes on. So each document comes to lie in one group of candidates, its shingles are
computed and moved there once, and all pairs of the group are verified exactly on the sets of 64-bit shingle hashes.

Documents of one sequence of words are one node. Subtrees and groups of more than ``BLOCK`` nodes (groups also by their number of
shingles) are dealt to blocks, and each pair of blocks is one unit of work. Only sums come out of a unit: for each node the
documents it is linked with, and the smallest node it hangs together with there, never the pairs themselves.

Defined results: null texts and texts without words link with nothing; a text of fewer words than n is one shingle of
all its words; a row without an id links with nothing and is a class of its own; rows that repeat an id are one
document, of the least of their texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import drop_stored, stored
from lectern.llm.blocks import by_group, dealt, linked_roots, once, roots, sides
from lectern.llm.components import connected_components
from lectern.llm.wordhash import batch_words, mix, shingles
from lectern.session import ship_package

WORDS = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 6
RECALL = 0.9997
DOUBT = 4.0
BLOCK = 1024
#: Shingles of a block of a group that is verified.
BLOCK_SHINGLES = 1_000_000
#: Characters of text hashed at once.
PIECE = 500_000


def shortest_prefix(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """How far prefixes are shortened: to the first length at which a pair at the threshold shares one in some tree with probability recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(29)
    return rng.integers(1, 1 << 62, TREES * DEPTH).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, TREES * DEPTH).astype(np.uint64)


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """uint32 [texts, TREES * DEPTH]: minimum hashes of each text's shingles; every text has some."""
    times, plus = _constants()
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), TREES * DEPTH), np.uint32)
    for at in range(0, len(counts), 64):  # few enough values to stay in the processor's cache
        first, last = starts[at], starts[min(at + 64, len(counts)) - 1] + counts[min(at + 64, len(counts)) - 1]
        some, cut = values[first:last], starts[at : at + 64] - first
        for k in range(TREES * DEPTH):
            out[at : at + 64, k] = np.minimum.reduceat(((some * times[k] + plus[k]) >> np.uint64(32)).astype(np.uint32), cut)
    return out


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _sign(width: int):
    """(doc_id, text) to (doc_id, k1, k2, sig): two hashes of the sequence of words, and the signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for at, end in _pieces(texts):
                hashes, counts = batch_words([t.encode("utf-8", "surrogatepass") for t in texts[at:end]])
                place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
                some = counts > 0
                if not some.any():
                    continue
                cut = (np.cumsum(counts) - counts)[some]
                keys = [np.add.reduceat(mix(hashes + np.uint64(seed)) * (mix(place.astype(np.uint64) + np.uint64(seed)) | np.uint64(1)), cut) for seed in (1, 2)]
                values, many = shingles(hashes, counts, width)
                sig = signatures(values, many[some])
                ids = batch["doc_id"].to_numpy()[at:end][some]
                yield pd.DataFrame({"doc_id": ids, "k1": keys[0].view(np.int64), "k2": keys[1].view(np.int64), "sig": [s.tobytes() for s in sig]})

    return run


def _prefixes(depth: int):
    """(node, sig) to one row per tree: bucket, the subtree below its label's first `depth` values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sig = np.frombuffer(b"".join(batch["sig"]), np.uint32).reshape(len(batch), TREES, DEPTH)
            bucket = np.broadcast_to(mix(np.arange(1, TREES + 1, dtype=np.uint64)), sig.shape[:2]).copy()
            for d in range(depth):
                bucket = mix(bucket + sig[:, :, d].astype(np.uint64))
            yield pd.DataFrame({"bucket": bucket.view(np.int64).ravel(), "tree": np.tile(np.arange(TREES, dtype=np.int8), len(batch)), "node": np.repeat(batch["node"].to_numpy(), TREES)})

    return run


def _like(sig: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose signatures agree in a share of at least `least` of their values."""
    a, b = [], []
    for at in range(0, len(left), 32):
        rows = left[at : at + 32]
        agree = np.zeros((len(rows), len(right)), np.int16)
        for k in range(sig.shape[1]):
            agree += sig[rows, k][:, None] == sig[right, k][None, :]
        x, y = np.nonzero(agree >= least * sig.shape[1])
        a.append(rows[x])
        b.append(right[y])
    a, b = np.concatenate(a), np.concatenate(b)
    keep = a < b if same else np.ones(len(a), bool)
    return a[keep], b[keep]


def trie_pairs(labels: np.ndarray, shortest: int, alike: Callable[[np.ndarray, np.ndarray], np.ndarray], apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that a tree's sorted labels bring together and that are alike, as far as they tell who hangs together.

    Rows meet at the longest prefix that they share: first those of one label, then, value by value, those below each shorter
    prefix, down to `shortest` values. A node of the trie whose rows hang together already is passed over, and so is, in every other node,
    each pair that does. apart: groups of rows; if given, only rows of different ones are compared.
    """
    order = np.lexsort(labels.T[::-1])
    below = labels[order]
    shared = np.concatenate([[0], (np.cumprod(below[1:] == below[:-1], axis=1)).sum(axis=1)])  # values shared with the row before
    found_a, found_b = [], []
    part, child = np.arange(len(order)), np.arange(len(order))  # who hangs together, and the node one value deeper
    for depth in range(labels.shape[1], shortest - 1, -1):
        node = np.cumsum(shared < depth)
        starts = np.nonzero(np.diff(node, prepend=-1))[0]
        links_a, links_b = [], []
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            if end - begin == 1 or (part[begin:end] == part[begin]).all():
                continue
            for at in range(begin, end, 128):
                rows = np.arange(at, min(at + 128, end))
                meet = (child[rows][:, None] != child[None, begin:end]) & (part[rows][:, None] != part[None, begin:end]) & (rows[:, None] < np.arange(begin, end)[None, :])
                if apart is not None:
                    meet &= apart[order[rows]][:, None] != apart[order[begin:end]][None, :]
                x, y = np.nonzero(meet)
                x, y = rows[x], begin + y
                if len(x):
                    near = alike(order[x], order[y])
                    links_a.append(x[near])
                    links_b.append(y[near])
        child = node
        if links_a and len(a := np.concatenate(links_a)):
            b = np.concatenate(links_b)
            found_a.append(a)
            found_b.append(b)
            part = linked_roots(len(order), np.concatenate(found_a), np.concatenate(found_b))
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return order[np.concatenate(found_a)], order[np.concatenate(found_b)]


def _may_link(least: float, shortest: int):
    """A subtree's rows (tree, node, sig) to (a, b): who hangs together there, by signatures."""

    def unit(part: pd.DataFrame) -> pd.DataFrame | None:
        sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(len(part), -1)

        def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.empty(len(a), bool)
            for at in range(0, len(a), 16384):
                out[at : at + 16384] = (sig[a[at : at + 16384]] == sig[b[at : at + 16384]]).mean(axis=1) >= least
            return out

        tree = int(part["tree"].iat[0])
        apart = None if part["i"].iat[0] == part["j"].iat[0] else part["block"].to_numpy()
        a, b = trie_pairs(sig[:, tree * DEPTH : (tree + 1) * DEPTH], shortest, alike, apart)
        if not len(a):
            return None
        node = part["node"].to_numpy()
        root = roots(node, a, b)
        some = root != node
        return pd.DataFrame({"a": node[some], "b": root[some]})

    return unit


def _verify(threshold: float, least: float):
    """Rows (node, n, sig, set) of a group to (node, links, root): exact links of each node here."""

    def unit(part: pd.DataFrame) -> pd.DataFrame | None:
        sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(len(part), -1)
        a, b = _like(sig, *sides(part), least)
        if not len(a):
            return None
        sets = [np.frombuffer(s, np.uint64) for s in part["set"]]
        size = np.array([len(s) for s in sets])
        values, local = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        hit = np.zeros(len(values), bool)
        link = np.zeros(len(a), bool)
        first = np.nonzero(np.diff(a, prepend=-1))[0]  # pairs stand in the order of a
        for at, end in zip(first, [*first[1:], len(a)], strict=True):
            x, other = a[at], b[at:end]
            own = local[ends[x] - size[x] : ends[x]]
            hit[own] = True
            span = size[other]
            starts = np.cumsum(span) - span
            where = np.arange(span.sum()) + np.repeat(ends[other] - span - starts, span)
            shared = np.add.reduceat(hit[local[where]].astype(np.int64), starts)
            hit[own] = False
            link[at:end] = shared >= threshold * (size[x] + span - shared) - 1e-9
        a, b = a[link], b[link]
        if not len(a):
            return None
        node, n = part["node"].to_numpy(), part["n"].to_numpy()
        links = np.bincount(a, n[b], len(node)) + np.bincount(b, n[a], len(node))
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "root": roots(node, a, b)[some]})

    return unit


def _shingle_sets(width: int):
    """(group, node, n, sig, text) to (group, node, n, sig, set): the distinct shingle hashes, sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for at, end in _pieces(texts):
                values, many = shingles(*batch_words([t.encode("utf-8", "surrogatepass") for t in texts[at:end]]), width)
                ends = np.cumsum(many)
                sets = [np.unique(values[e - m : e]) for e, m in zip(ends, many, strict=True)]
                yield batch.iloc[at:end].drop(columns="text").assign(set=[s.tobytes() for s in sets], size=[len(s) for s in sets])

    return run


def _once(docs: DataFrame) -> DataFrame:
    """The rows of docs with an id, one per id: of rows that repeat one, a row of the least text."""
    return once(docs, "doc_id", F.struct(F.col("text").isNull(), F.col("text")))


def near_texts(docs: DataFrame, threshold: float = THRESHOLD, width: int = WORDS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, class_id (smallest id of those linked directly or not), n_links (documents linked directly)."""
    ship_package(docs.sparkSession)
    depth = shortest_prefix(threshold)
    least = max(0.0, threshold - DOUBT * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    full = _once(given).filter("text IS NOT NULL")
    signed = stored(full.mapInPandas(_sign(width), "doc_id long, k1 long, k2 long, sig binary"), "signatures")
    nodes = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    nodes = stored(nodes, "nodes")
    sigs = signed.select(F.col("doc_id").alias("node"), "sig").join(nodes.select("node", "n"), "node")
    sigs = stored(sigs, "node-signatures")

    # who meets whom in the forest, and may be similar by the signatures
    met = stored(sigs.select("node", "sig").mapInPandas(_prefixes(depth), "bucket long, tree byte, node long"), "prefixes")
    sizes = met.groupBy("bucket").count().filter("count > 1").select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    trees = met.join(sizes, "bucket").join(sigs.select("node", "sig"), "node")
    maybe = dealt(trees, "bucket").mapInPandas(by_group(["bucket", "i", "j"], _may_link(least, depth)), "a long, b long")
    groups = stored(connected_components(maybe), "groups")

    # exact verification within the groups
    picked = groups.select("node", F.col("component").alias("group")).join(sigs, "node").withColumnRenamed("node", "doc_id")
    texts = full.join(picked, "doc_id").select("group", F.col("doc_id").alias("node"), "n", "sig", "text")
    sets = stored(texts.mapInPandas(_shingle_sets(width), "group long, node long, n long, sig binary, set binary, size long"), "shingle-sets")
    span = sets.groupBy("group").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    span = span.select("group", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    found = dealt(sets.join(span, "group"), "group").mapInPandas(by_group(["group", "i", "j"], _verify(threshold, least)), "node long, links long, root long")
    found = stored(found, "text-links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.join(links, "node", "left").join(parts, "node", "left")
    known = known.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("class_id"))
    per_doc = signed.select("doc_id", "k1", "k2").join(known, ["k1", "k2"]).select("doc_id", "n_links", "class_id")
    out = given.select("doc_id").join(per_doc, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, width: int = WORDS) -> DataFrame:
    """The rows of docs that stand for their class (the smallest id of each), with their own columns; of rows that repeat an id, one."""
    copies = stored(near_texts(docs, threshold, width).filter("doc_id <> class_id").select("doc_id").distinct(), "copies")
    kept = _once(docs).join(copies, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(docs.filter("doc_id IS NULL"))

"""Scoring texts by a context-mixing language model that is learnt from the training part of the corpus.

The model is described in context_mixing.py. All that it holds is gathered from every training document, whole, and grows with
the corpus: token counts by kind of document, every context of two tokens that occurs more than once and what follows it, and what
follows contexts of bytes within the distinct words. None of it is broadcast. Documents are handled in groups; each group is sent
the counts of its own tokens and what its own contexts expect, each chunk of distinct words the counts of its own contexts of
bytes. Tokens, contexts of tokens and contexts of bytes are all counted within a group or chunk first, then in ranges of their hashes; both
ways they travel as packed arrays, never as rows. Broadcast are only the centres of the kinds, their totals and the weights of the spelling, some thousand
numbers. Kinds are clusters of all training documents by k-means, started from centres drawn from all of them; the spelling's weights are learnt in each chunk from all of
its words and averaged.

A document is of the training part if crc32 of its id as text, modulo 7, is not 2. Groups are ranges of rows of the input files, apart for
longer documents, so that they are the same in all passes. Defined results: null and empty texts are the end token alone; tokens are
kept as 64-bit hashes and contexts of two as 52-bit ones; rows that repeat an id are scored, and learnt from, each; a null id counts as an empty text; without any training
document every prediction is that of empty tables; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.llm import context_mixing as cm
from lectern.llm._shared import crc_mod, drop_stored, n_bytes, stored
from lectern.session import ship_package

MODULUS, HELD_OUT = 7, 2
GROUP_BYTES, MOST_GROUP_BYTES = 16_000_000, 256_000_000
#: Documents above this size, and above each so many times of it, are in groups of their own.
SMALL_BYTES, SIZE_STEP = 16_384, 4
CHUNK_TEXT_BYTES = 24_000_000  # text whose distinct tokens share a range, which is a chunk of the spelling
BATCH_CHARS = 600_000
GATHER_ROWS = 50_000
#: Distinct tokens of the runs that are gathered before they are put together.
GATHER_TOKENS = 500_000
#: Text whose contexts share a range, and tokens whose contexts are gathered before they are put together.
RANGE_BYTES, GATHER_CONTEXTS = 4_000_000, 1_000_000
#: Ranges of contexts of bytes, where there are not more chunks: rows of packed counts stay below half a megabyte.
SPELL_RANGES = 256
#: Bytes of the rows that Python is handed at once.
BATCH_BYTES = 2_000_000
#: Arrays of so many bytes are given back to the system as soon as they are no longer used.
RETURNED_BYTES = 4_000_000
#: Clusterings of all training documents, of which the best is taken, and their steps.
KIND_TRIES, KIND_STEPS = 8, 10
#: Steps in which all groups are scored, one after the other: the shuffled files of one are deleted before the next.
SCORE_STEPS = 2

_COUNTS = [f"n{k}" for k in range(cm.KINDS)]
_COUNT_COLUMNS = ", ".join(f"{n} long" for n in _COUNTS)


def _encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(sizes):
        to, total = at + 1, sizes[at]
        while to < len(sizes) and total + sizes[to] <= BATCH_CHARS:
            total += sizes[to]
            to += 1
        yield at, to
        at = to


# --- kinds ----------------------------------------------------------------------------------------------------------------


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts to the vectors that tell their kind, in units of 1/255."""
    for batch in batches:
        for at, to in _runs([len(t) for t in batch["text"]]):
            _, count, _, _, hashes, _ = cm.token_hashes(_encoded(batch["text"].iloc[at:to]))
            x = np.rint(255 * cm.shares(count, hashes)).astype(np.uint8)
            yield pd.DataFrame({"v": [v.tobytes() for v in x]})


def _unit(blobs: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), cm.KIND_WIDTH).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _drawn(centres: np.ndarray):
    """For each try, of the vectors of a task the one that comes first as its next centre; centres [KIND_TRIES, so far, KIND_WIDTH]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, hashes = _unit(batch["v"]), batch["h"].to_numpy().view(np.uint64)
            wait = [cm.waits(x, hashes, t, centres[t]) for t in range(KIND_TRIES)]
            first = [int(np.argmin(w)) for w in wait]
            yield pd.DataFrame({"t": np.arange(KIND_TRIES), "wait": [w[k] for w, k in zip(wait, first, strict=True)], "v": batch["v"].to_numpy()[first]})

    return run


def _nearest_sums(centres: np.ndarray):
    """Sums of the vectors nearest to each centre of each try, and last those of their products with it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, fit = np.zeros(centres.shape), np.zeros(len(centres))
        for batch in batches:
            if len(batch):
                x = _unit(batch["v"])
                for t, mine in enumerate(centres):
                    sums[t] += cm.kind_sums(x, mine)
                    fit[t] += (x @ mine.T).max(axis=1).sum()
        # whole numbers, so that their sums don't depend on an order
        cells = np.concatenate([sums.ravel(), fit])
        yield pd.DataFrame({"cell": np.arange(len(cells)), "s": np.rint(cells * 2**20).astype(np.int64)})

    return run


def fit_kinds(texts: DataFrame) -> np.ndarray:
    """Centres of the kinds of all these texts: of several clusterings, each started from centres drawn from all texts, the one that fits best."""
    vectors = stored(texts.select("text").mapInPandas(_vectors, "v binary").select("v", F.xxhash64("v").alias("h")), "lm-vectors")
    centres = np.empty((KIND_TRIES, 0, cm.KIND_WIDTH))
    for _ in range(cm.KINDS):
        drawn = vectors.mapInPandas(_drawn(centres), "t int, wait double, v binary").groupBy("t").agg(F.min_by("v", F.struct("wait", "v")).alias("v")).orderBy("t")
        rows = [r["v"] for r in drawn.collect()]  # one row for each try
        if not rows:
            drop_stored(vectors)
            return np.zeros((cm.KINDS, cm.KIND_WIDTH))
        centres = np.concatenate([centres, _unit(pd.Series(rows))[:, None]], axis=1)
    fit = np.zeros(KIND_TRIES)
    for _ in range(KIND_STEPS):
        cells = np.zeros(centres.size + KIND_TRIES)
        for r in vectors.mapInPandas(_nearest_sums(centres), "cell long, s long").groupBy("cell").agg(F.sum("s").alias("s")).collect():  # one row for each number of the centres
            cells[r["cell"]] = r["s"] / 2**20
        sums, fit = cells[: centres.size].reshape(centres.shape), cells[centres.size :]
        centres = np.stack([cm.next_centres(c, s) for c, s in zip(centres, sums, strict=True)])
    drop_stored(vectors)
    return centres[int(np.argmax(fit))]


# --- what groups hold -----------------------------------------------------------------------------------------------------


class _Gathered:
    """Distinct tokens of a group, from those of its runs: hashes, letters and counts by kind."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, tokens: cm.Tokens, n: np.ndarray) -> None:
        self.parts.append((tokens.keys, tokens.length.astype(np.uint32), tokens.letters(), n.astype(np.uint32)))
        self.size += len(tokens.keys)
        if self.size > GATHER_TOKENS and len(self.parts) > 1:
            self.parts = [self.together()]
            self.size = 0  # of what came since

    def together(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return _same_tokens(*(np.concatenate([p[k] for p in self.parts], axis=-1) for k in range(4)))[:4]

    def rows(self, grp: int, ranges: int) -> Iterator[pd.DataFrame]:
        keys, length, letters, n = self.together()
        cuts, begin = _range_cuts(keys >> np.uint64(32), ranges), np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        some = np.nonzero(np.diff(cuts))[0]
        for at in range(0, len(some), GATHER_ROWS):
            mine = some[at : at + GATHER_ROWS]
            data = [_packed_tokens(keys[a:b], length[a:b], letters[begin[a] : begin[b]], n[:, a:b]) for a, b in zip(cuts[mine].tolist(), cuts[mine + 1].tolist(), strict=True)]
            yield pd.DataFrame({"range": mine, "grp": grp, "data": data})


def _same_tokens(keys: np.ndarray, length: np.ndarray, letters: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens in order, with the sums of their counts n [KINDS, tokens], and which one each was."""
    size = length.astype(np.int64)
    start = np.cumsum(size) - size
    keys, first, which = cm.distinct(keys)
    size, start = size[first], start[first]
    letters = letters[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]
    return keys, length[first], letters, np.stack([np.bincount(which, row, len(keys)).astype(n.dtype) for row in n]), which


def _range_cuts(first_bits: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of ordered hashes begins, told by their first 32 bits."""
    return np.searchsorted(first_bits * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))


def _gather(centres: np.ndarray, ranges: int):
    """(grp, train, text) to groups' distinct tokens, their bytes and their training counts by kind of document, by range of tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, _Gathered] = {}
        for batch in batches:
            for grp, part in batch.groupby("grp", sort=False):
                train = part["train"].to_numpy(bool)
                for at, to in _runs([len(t) for t in part["text"]]):
                    tokens = cm.Tokens(_encoded(part["text"].iloc[at:to]))
                    kinds = np.argmax(cm.kind_vectors(tokens) @ centres.T, axis=1)
                    size = len(tokens.keys)
                    cell = np.repeat(kinds, tokens.count) * size + tokens.which
                    n = np.bincount(cell[np.repeat(train[at:to], tokens.count)], minlength=cm.KINDS * size).reshape(cm.KINDS, size)
                    held.setdefault(int(grp), _Gathered()).add(tokens, n)
            while len(held) > 4:  # rows of a group are neighbours: the oldest ones have ended, or will add to what is sent now
                grp = next(iter(held))
                yield from held.pop(grp).rows(grp, ranges)
        while held:
            grp = next(iter(held))
            yield from held.pop(grp).rows(grp, ranges)

    return run


def _planes(values: np.ndarray, many: int | None = None) -> bytes:
    """First bytes of all numbers, then all second ones, and so on, as many as asked for: those of small numbers are zeros, which compress."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize)[:, :many].T).tobytes()


def _packed(keys: np.ndarray, *numbers: np.ndarray) -> bytes:
    """Keys in order as differences, then numbers of 64 bits that belong to them, one array after the other, each by as many bytes as it needs."""
    arrays = [np.ascontiguousarray(a).view(np.uint64) for a in (np.diff(keys, prepend=np.uint64(0)), *numbers)]
    many = [max(1, (int(a.max(initial=0)).bit_length() + 7) // 8) for a in arrays]
    return b"".join([bytes(many), *(_planes(a, m) for a, m in zip(arrays, many, strict=True))])


def _unpacked(data: bytes | pa.Buffer, numbers: int) -> list[np.ndarray]:
    """[keys, whole numbers...] of _packed."""
    raw = np.frombuffer(data, np.uint8)
    many, at, out = raw[: 1 + numbers].tolist(), 1 + numbers, []
    size = (len(raw) - at) // sum(many)
    for m, kind in zip(many, [np.uint64] + [np.int64] * numbers, strict=True):
        cells = np.zeros((size, 8), np.uint8)
        cells[:, :m] = raw[at : at + m * size].reshape(m, size).T
        out.append(cells.view(kind).ravel())
        at += m * size
    return [np.cumsum(out[0]), *out[1:]]


def _put_together(packed: list[bytes | pa.Buffer], numbers: int) -> list[np.ndarray]:
    """[keys in order, whole numbers...] of several of _packed."""
    parts = [_unpacked(data, numbers) for data in packed] or [[np.empty(0, np.uint64), *[np.empty(0, np.int64)] * numbers]]
    parts.sort(key=lambda part: part[0][:1].tolist())
    columns = list(zip(*parts, strict=True))[::-1]
    del parts
    keys, *rest = [np.concatenate(columns.pop()) for _ in range(1 + numbers)]  # the parts of one are freed before the next is put together
    if (keys[1:] >= keys[:-1]).all():  # ranges of hashes, one of each
        return [keys, *rest]
    order = np.argsort(keys, kind="stable")
    return [keys[order], *(n[order] for n in rest)]


def _packed_tokens(keys: np.ndarray, length: np.ndarray, letters: np.ndarray, n: np.ndarray) -> bytes:
    """Tokens in order of their hashes: how many, hashes as differences, lengths, counts [rows, tokens] and the bytes of all."""
    return b"".join([np.uint64(len(keys)).tobytes(), _planes(np.diff(keys, prepend=np.uint64(0))), _planes(length), *map(_planes, n), letters.tobytes()])


def _unpacked_tokens(data: bytes, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, lengths, bytes, counts [rows, tokens]) of _packed_tokens."""
    raw = np.frombuffer(data, np.uint8)
    many = int(raw[:8].view(np.uint64)[0])
    ends = 8 + many * np.array([8, 12, 12 + 4 * rows])
    keys = np.cumsum(np.ascontiguousarray(raw[8 : ends[0]].reshape(8, -1).T).view(np.uint64).ravel())
    small = np.ascontiguousarray(raw[ends[0] : ends[2]].reshape(1 + rows, 4, -1).swapaxes(1, 2)).view(np.uint32)[:, :, 0]
    return keys, small[0], raw[ends[2] :], small[1:]


#: What a row of packed arrays holds: a group's tokens with their counts, what it expects, the spelling of its strange tokens; a chunk's tokens.
TOKENS, EXPECTED, SPELLED, CHUNK = 0, 1, 2, 3


def _summed(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
    """A range's tokens, their counts summed over all groups: a row for each group that asks, and one of the range's distinct tokens, a chunk of the spelling.

    The chunk's row is followed by those of its strange tokens (counts are 0) that each group has, as a spelling asked for.
    """
    parts = [_unpacked_tokens(data, cm.KINDS) for data in sent["data"]]
    keys, length, letters, n, which = _same_tokens(*(np.concatenate([p[k] for p in parts], axis=-1) for k in range(3)), np.concatenate([p[3] for p in parts], axis=-1).astype(np.int64))
    learnt = n.sum(axis=0) > 0
    out: dict[str, list] = {"what": [CHUNK], "grp": [0], "data": [_packed_tokens(keys, length, letters, learnt[None].astype(np.uint32))]}
    ends = np.cumsum([len(p[0]) for p in parts])
    for grp, (mine, *_), end in zip(sent["grp"].tolist(), parts, ends.tolist(), strict=True):
        some = which[end - len(mine) : end]
        out["what"].append(TOKENS)
        out["grp"].append(grp)
        out["data"].append(_packed(mine, *n[:, some]))
        if len(strange := mine[~learnt[some]]):
            out["what"].append(SPELLED)
            out["grp"].append(grp)
            out["data"].append(_packed(strange))
    totals = np.zeros((len(_COUNTS) + 1, len(out["what"])), np.int64)
    totals[:, 0] = [*n.sum(axis=1), learnt.sum()]
    return pd.DataFrame({"chunk": key[0]} | out | dict(zip([*_COUNTS, "known"], totals, strict=True)))


def _context_counts(ranges: int):
    """(grp, train, text) to groups' counts of what follows their contexts in training texts, by range of contexts; 0 follows in other texts."""

    def rows(grp: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        contexts, follow = map(np.concatenate, zip(*parts, strict=True))
        contexts, follow, n = cm.context_counts(contexts, follow, (follow != 0).astype(np.int64))
        cuts = _range_cuts(contexts >> np.uint64(cm.CONTEXT_BITS - 32), ranges)
        some = np.nonzero(np.diff(cuts))[0]
        for at in range(0, len(some), GATHER_ROWS):
            mine = some[at : at + GATHER_ROWS]
            data = [_packed(contexts[a:b], follow[a:b].astype(np.int64), n[a:b]) for a, b in zip(cuts[mine].tolist(), cuts[mine + 1].tolist(), strict=True)]
            yield pd.DataFrame({"range": mine, "grp": grp, "data": data})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            for grp, part in batch.groupby("grp", sort=False):
                train = part["train"].to_numpy(bool)
                for begin, end in _runs([len(t) for t in part["text"]]):
                    tokens = cm.Tokens(_encoded(part["text"].iloc[begin:end]))
                    contexts = tokens.contexts()
                    at = cm.anchors(contexts)
                    if len(at):
                        follow = np.where(train[begin:end][tokens.places()[0][at]], tokens.follow(at)[:, 0], np.uint32(0))
                        held.setdefault(int(grp), []).append((contexts[at], follow))
                        size += len(at)
                    while size > GATHER_CONTEXTS:  # the oldest group has ended, or will add to what is sent now
                        oldest = next(iter(held))
                        size -= sum(len(c) for c, _ in held[oldest])
                        yield from rows(oldest, held.pop(oldest))
        for grp, parts in held.items():
            yield from rows(grp, parts)

    return run


def _expected(key: tuple, counted: pd.DataFrame) -> pd.DataFrame:
    """A range's counts, summed over all groups, to what is expected after each group's own contexts."""
    parts = [_unpacked(data, 2) for data in counted["data"]]
    contexts, follow, n = map(np.concatenate, zip(*parts, strict=True))
    known = cm.expectations(*cm.context_counts(contexts, follow.astype(np.uint32), n))
    known["follow"] = known["follow"][:, 0].astype(np.int64)
    out: dict[str, list] = {"grp": [], "data": []}
    for grp, (contexts, _, _) in zip(counted["grp"].tolist(), parts, strict=True):
        mine = contexts[np.diff(contexts, prepend=~contexts[:1]) != 0]
        row = np.searchsorted(known["context"], mine)
        row = row[np.append(known["context"], np.uint64(0))[row] == mine]  # a context is never 0
        if len(row):
            out["grp"].append(grp)
            out["data"].append(_packed(*(known[k][row] for k in ("context", "follow", "most", "times"))))
    return pd.DataFrame(out).astype({"grp": "int64"})


# --- spelling -------------------------------------------------------------------------------------------------------------


def _chunk_tokens(words: pd.DataFrame) -> tuple[cm.Tokens, np.ndarray]:
    """The tokens of a chunk's row, and which of them are in training texts."""
    keys, length, letters, learnt = _unpacked_tokens(words["data"].iat[0], 1)
    ends, data = np.cumsum(length, dtype=np.int64), letters.tobytes()
    return cm.Tokens.of(keys, [data[e - m : e] for e, m in zip(ends.tolist(), length.tolist(), strict=True)]), learnt[0] > 0


def _contexts(ranges: int):
    """A chunk's distinct (context << 8 | symbol) with how many training words hold them, by range of contexts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(len(batch)):
                tokens, learnt = _chunk_tokens(batch.iloc[k : k + 1])
                pairs, n = cm.pair_counts(tokens, np.nonzero(learnt)[0])
                others = cm.pair_counts(tokens, np.nonzero(~learnt)[0])[0]
                pairs, first = np.unique(np.concatenate([pairs, others]), return_index=True)
                n = np.concatenate([n, np.zeros(len(others), np.int64)])[first]
                part = (cm.mix(pairs >> np.uint64(8)) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(ranges + 1, dtype=np.uint64))
                some = np.nonzero(np.diff(cuts))[0]
                data = [_packed(pairs[mine], n[mine]) for mine in (order[a:b] for a, b in zip(cuts[some].tolist(), cuts[some + 1].tolist(), strict=True))]
                yield pd.DataFrame({"range": some, "chunk": batch["chunk"].iat[k], "data": data})

    return run


def _context_sums(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
    """A range's counts, summed over all chunks: for each chunk, those of all symbols after its own contexts."""
    parts = [_unpacked(data, 1) for data in sent["data"]]
    pairs, n = map(np.concatenate, zip(*parts, strict=True))
    pairs, _, which = cm.distinct(pairs)
    n = cm.added(which, n, len(pairs))
    pairs, n = pairs[n > 0], n[n > 0]
    context, data = pairs >> np.uint64(8), []
    for mine, _ in parts:
        asked = mine >> np.uint64(8)
        asked = asked[np.diff(asked, prepend=~asked[:1]) != 0]
        low, high = np.searchsorted(context, asked), np.searchsorted(context, asked, side="right")
        many = high - low
        at = np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)
        data.append(_packed(pairs[at], n[at]))
    return pd.DataFrame({"chunk": sent["chunk"], "data": data})


def _table(counts: pd.DataFrame) -> cm.Counts:
    return cm.Counts(*_put_together(counts["data"].tolist(), 1))


def _learn(key: tuple, words: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    tokens, learnt = _chunk_tokens(words)
    if not learnt.any():
        return pd.DataFrame({"cell": [], "w": [], "n": []}).astype({"cell": "int64", "w": "float64", "n": "int64"})
    weights, n = cm.fit_weights(tokens.some(learnt), _table(counts))
    return pd.DataFrame({"cell": np.arange(weights.size), "w": weights.ravel().astype(np.float64), "n": n})


def _spell(weights: np.ndarray):
    """The spelling of a chunk's strange tokens, for each group that asks for some."""

    def run(key: tuple, words: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        asks = words[words["what"] == SPELLED]
        tokens, learnt = _chunk_tokens(words[words["what"] == CHUNK])
        strange = np.nonzero(~learnt)[0]
        spelled = cm.spell(tokens, strange, _table(counts), weights) if len(strange) else np.empty(0)
        data = []
        for asked in asks["data"]:
            (mine,) = _unpacked(asked, 0)
            data.append(_packed(mine, spelled[np.searchsorted(tokens.keys[strange], mine)].view(np.int64)))
        return pd.DataFrame({"what": np.full(len(asks), SPELLED), "grp": asks["grp"], "data": data})

    return run


# --- scores ---------------------------------------------------------------------------------------------------------------


def _score(totals: np.ndarray, id_type: pa.DataType):
    """Texts of a group and what it has asked for to their scores; texts and packed arrays are read where Arrow holds them."""

    def run(key: tuple, docs: pa.Table, known: pa.Table) -> pa.Table:
        held: dict[int, list[pa.Buffer]] = {TOKENS: [], EXPECTED: [], SPELLED: []}
        for batch in known.to_batches():
            for what, data in zip(batch["what"].to_pylist(), batch["data"], strict=True):
                held[what].append(data.as_buffer())
        texts = docs["text"].cast(pa.binary())
        words, *by_kind = _put_together(held.pop(TOKENS), cm.KINDS)
        by_kind = np.stack(by_kind)
        strange, spelling = _put_together(held.pop(SPELLED), 1)
        spelled = np.zeros(len(words))
        spelled[np.searchsorted(words, strange)] = spelling.view(np.float64)
        context, follow, most, times = _put_together(held.pop(EXPECTED), 3)
        expected = {"context": context, "follow": follow.astype(np.uint32).reshape(-1, cm.FOLLOW), "most": most, "times": times}
        del follow
        out: dict[str, list] = {"bytes": [], "n_tokens": [], "n_known": [], "log_counts": [], "score": []}
        for at, to in _runs(pc.binary_length(texts).to_pylist()):
            tokens = cm.Tokens(some := texts.slice(at, to - at).to_pylist())
            out["bytes"].append(np.array([len(t) for t in some]))
            mine = tokens.keys
            place = np.minimum(np.searchsorted(words, mine), len(words) - 1)
            if not (words[place] == mine).all():
                raise RuntimeError("the input changed between two passes: a group holds a token that it has not asked for")
            kinds = by_kind[:, place]
            c = kinds.sum(axis=0)
            starts = np.cumsum(tokens.count) - tokens.count
            out["n_tokens"].append(tokens.count)
            out["n_known"].append(np.add.reduceat((c > 0)[tokens.which].astype(np.int64), starts))
            out["log_counts"].append(np.add.reduceat(np.log10(c + 1.0)[tokens.which], starts))
            out["score"].append(cm.text_log(tokens, kinds, totals, spelled[place], expected) / math.log(10))
        return pa.table({"doc_id": docs["doc_id"].cast(id_type), "train": docs["train"]} | {k: np.concatenate(v) for k, v in out.items()})

    return run


def _grouped(docs: DataFrame) -> tuple[DataFrame, int]:
    """(grp, doc_id, train, text), and the number of bytes: groups of neighbouring rows of the files that docs is read from.

    Documents of like size share groups, of some GROUP_BYTES where their sizes are spread evenly, and of MOST_GROUP_BYTES or one document at most.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (crc_mod("doc_id", MODULUS) != HELD_OUT).alias("train"))
    try:
        rows = rows.select("*", "_metadata.file_path", "_metadata.row_index")
    except AnalysisException:  # not read from files
        rows = stored(rows, "lm-docs").select("*", "_metadata.file_path", "_metadata.row_index")
    size = n_bytes("text")
    longer = F.coalesce(F.greatest(F.lit(0.0), F.ceil(F.log(float(SIZE_STEP), size / SMALL_BYTES))), F.lit(0)).cast("int")
    classes = docs.groupBy(longer.alias("longer")).agg(F.count("*").alias("n"), F.sum(size).alias("size")).collect()  # one row for each class of sizes
    n = sum(c["n"] for c in classes)
    per = F.lit(1.0)
    for c in classes:
        rows_in = min(GROUP_BYTES * n / max(c["size"], 1), MOST_GROUP_BYTES / (SMALL_BYTES * SIZE_STEP ** c["longer"]))
        per = F.when(longer == c["longer"], F.lit(max(1.0, rows_in))).otherwise(per)
    return rows.select(F.xxhash64("file_path", longer, F.floor(F.col("row_index") / per)).alias("grp"), "doc_id", "train", "text"), sum(c["size"] for c in classes)


#: Settings under which the tables are made: files of a shuffle are deleted with the step that read them, few rows of packed arrays or texts are held at once
#: (by their bytes also where a group is handed over, which is else copied whole, outside the heap), and few groups are sorted in a task.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.columnarReaderBatchSize": "128",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
}


def _stored(df: DataFrame, name: str) -> DataFrame:
    """stored(), after which the files that were shuffled for the table are deleted: nothing reads them again."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        conf.set(k, v)
    try:
        return stored(df, name)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def _lean() -> None:
    """From now on a worker gives large arrays back to the system when they are freed, not when what was allocated after them is."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, RETURNED_BYTES)  # M_MMAP_THRESHOLD, which else follows the largest array so far


def _trim() -> None:
    """Give the system back what a worker no longer uses: workers stay, and hold what they have had at once."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _tidy(f):
    """A function of batches, after which memory is given back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _lean()
        yield from f(batches)
        _trim()

    return run


def _tidy_group(f):
    """A function of a group, after which memory is given back."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _lean()
        out = f(key, rows)
        _trim()
        return out

    return run


def _tidy_pair(f):
    """A function of two groups (frames, or tables of Arrow), after which memory is given back."""

    def run(key, left, right):
        _lean()
        out = f(key, left, right)
        _trim()
        return out

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    spark = docs.sparkSession
    ship_package(spark)
    grouped, n_text = _grouped(docs)
    centres = fit_kinds(grouped.filter("train"))
    texts = grouped.select("grp", "train", "text")
    packed = "what int, grp long, data binary"

    # contexts: of those that occur more than once in training texts, what most often follows
    ranges = max(1, math.ceil(n_text / RANGE_BYTES))
    counted = texts.mapInPandas(_tidy(_context_counts(ranges)), "range int, grp long, data binary")
    expected = _stored(counted.groupBy("range").applyInPandas(_tidy_group(_expected), "grp long, data binary"), "lm-expected")

    # tokens
    chunks = max(1, math.ceil(n_text / CHUNK_TEXT_BYTES))
    asked = texts.mapInPandas(_tidy(_gather(centres, chunks)), "range int, grp long, data binary")
    words = _stored(asked.groupBy("range").applyInPandas(_tidy_group(_summed), f"chunk int, {packed}, {_COUNT_COLUMNS}, known long"), "lm-tokens")
    *totals, n_distinct = words.agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in [*_COUNTS, "known"]]).first()
    n_train = sum(totals)

    # spelling
    chunked = words.filter(F.col("what") == CHUNK).select("chunk", "data")
    sent = chunked.mapInPandas(_tidy(_contexts(max(chunks, min(ranges, SPELL_RANGES)))), "range int, chunk int, data binary")
    theirs = _stored(sent.groupBy("range").applyInPandas(_tidy_group(_context_sums), "chunk int, data binary"), "lm-chunk-counts")
    learnt = _stored(chunked.groupBy("chunk").cogroup(theirs.groupBy("chunk")).applyInPandas(_tidy_pair(_learn), "cell long, w double, n long"), "lm-weights")
    weights = cm.start_weights()
    for r in learnt.groupBy("cell").agg(F.sum(F.round(F.col("w") * F.col("n")).cast("decimal(38,0)")).alias("w"), F.sum("n").alias("n")).collect():  # one row for each weight
        weights.ravel()[r["cell"]] = float(r["w"]) / r["n"]
    strange = words.filter(F.col("what") != TOKENS).select("chunk", "what", "grp", "data")
    spelled = _stored(strange.groupBy("chunk").cogroup(theirs.groupBy("chunk")).applyInPandas(_tidy_pair(_spell(weights)), packed), "lm-spelled")
    drop_stored(theirs)
    drop_stored(learnt)

    known = words.filter(F.col("what") == TOKENS).select("what", "grp", "data").unionByName(spelled)
    known = known.unionByName(expected.withColumn("what", F.lit(EXPECTED)))
    kind, score = docs.schema["doc_id"].dataType.simpleString(), _tidy_pair(_score(np.array(totals), to_arrow_type(docs.schema["doc_id"].dataType)))
    out = f"doc_id {kind}, train boolean, bytes long, n_tokens long, n_known long, log_counts double, score double"
    scored = None
    for step in range(SCORE_STEPS):
        mine = F.pmod(F.shiftright("grp", 17), F.lit(SCORE_STEPS)) == step
        part = grouped.filter(mine).groupBy("grp").cogroup(known.filter(mine).groupBy("grp")).applyInArrow(score, out)
        part = _stored(part, "lm-scores")
        scored = part if scored is None else scored.unionByName(part)
    for table in (words, expected, spelled):
        drop_stored(table)
    total = math.log10(n_train + n_distinct + 1)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(total)).alias("base_score"), "score",
        F.when(F.col("bytes") > 0, -F.col("score") / math.log10(2) / F.col("bytes")).alias("bits_per_byte"),
    )

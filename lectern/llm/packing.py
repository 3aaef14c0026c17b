"""Packing documents into sequences by lexical retrieval.

Each document's token ids, closed by an end id, are cut at every full window; the full windows are sequences of their own.
What remains of each document is dealt to shards of about ``SHARD_DOCS`` documents, by likeness: documents are sorted by
``KEYS`` weighted minimum hashes of their whole text's token ids, rarer (later) ids weighing more, so that those who share rare terms
stand together at every size of the corpus, and stretches of that order are the shards. A shard holds a BM25 inverted index of
its remainders, with token ids as terms and the corpus's document frequencies and mean length. The longest unused remainder is the seed of
the next window; the index returns
its unused neighbours, best first, and they fill the window in that order, the last one cut to fit, with its rest left for
a later window. When a shard runs out of remainders, its last window is laid out as sequences whose lengths are powers of two,
which need no padding either.

Only remainders and check sums of full windows are shuffled, never whole texts; a shard holds at most about
SHARD_DOCS windows of ids, whatever the length of the documents. The document frequencies are one number for each term of the vocabulary.

Defined results: a null or empty text is the end id alone; rows that repeat an id are packed each; a null id passes through; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import stored
from lectern.llm.transducers import byte_alphabet
from lectern.llm.wordhash import mix
from lectern.session import ship_package

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 512
#: Shards of one task.
TASK_SHARDS = 8
#: Minimum hashes that documents are sorted by.
KEYS = 3
K1, B = 1.2, 0.75


@functools.cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids as the tokenizers library gives them for a vocabulary file, without added special tokens.

    Where merges stand in the order of the ids and the pre-tokenizer is the byte-level one, the faster library of the same algorithm
    reads the same vocabulary; for any other file, and for a text that it can't handle, tokenizers itself encodes.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    slow = lambda text: np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    specials = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"])}
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model.get("merges", [])]
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    if not plain or spec["normalizer"] or model.get("dropout") or made != list(range(256, 256 + len(made))) or len(specials) != len(spec["added_tokens"]):
        return slow
    import public_tokenizers
    import tiktoken

    letter = byte_alphabet()
    ranks = {bytes(letter[c] for c in t): i for t, i in model["vocab"].items() if t not in specials}
    fast = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials)
    allowed = set(specials)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        except Exception:  # its regular expressions have limits that tokenizers lacks
            return slow(text)

    return encode


_terms: dict[str, np.ndarray] = {}


def _term_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(waits [KEYS, terms], keys [terms]) of at least the first `size` terms: a document's first term to come is its minimum hash."""
    if len(_terms.get("keys", ())) < size:
        terms = np.arange(1 << (size - 1).bit_length(), dtype=np.uint64)
        weight = np.log1p(terms.astype(np.float64) / 256)  # ids of the vocabulary come in the order of their frequency
        u = [(mix(terms + np.uint64((k + 1) << 40)) >> np.uint64(11)).astype(np.float64) / 2**53 for k in range(KEYS)]
        _terms["waits"] = np.stack([-np.log(np.maximum(x, 1e-300)) / np.maximum(weight, 1e-6) for x in u])
        _terms["keys"] = (mix(terms) >> np.uint64(33)).astype(np.int64)
    return _terms["waits"], _terms["keys"]


def likeness_keys(ids: np.ndarray) -> list[int]:
    """KEYS weighted minimum hashes of a document's distinct ids: two documents share one with the weight of what they share."""
    waits, keys = _term_tables(int(ids.max()) + 1)
    at = ids.astype(np.intp)
    return [int(keys[at[np.argmin(row[at])]]) for row in waits]


def _cut(vocabulary: str, window: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                tokens, sums, rests, keys = [], [], [], []
                for text in some["text"]:
                    ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                    full = len(ids) // window
                    tokens.append(len(ids))
                    keys.append(likeness_keys(ids))
                    sums.append([zlib.crc32(ids[k * window : (k + 1) * window].tobytes()) for k in range(full)])
                    rest = ids[full * window :]
                    rests.append((rest.astype("<u2") if not len(rest) or rest.max() < 65536 else rest).tobytes())
                wide = [len(r) // 2 != n % window for n, r in zip(tokens, rests, strict=True)]
                yield pd.DataFrame({"doc_id": some["doc_id"], "doc_tokens": tokens, "sums": sums, "rest": rests, "wide": wide} | {f"key{k}": [x[k] for x in keys] for k in range(KEYS)})

    return run


def _ids(rest: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(rest, "<u4" if wide else "<u2")


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, df) of a part of the documents; term -1: their tokens."""
    total, tokens = np.zeros(0, np.int64), 0
    for batch in batches:
        for rest, wide in zip(batch["rest"], batch["wide"], strict=True):
            ids = _ids(rest, wide)
            tokens += len(ids)
            if len(ids):
                if (top := int(ids.max())) >= len(total):
                    total = np.concatenate([total, np.zeros(top + 1024 - len(total), np.int64)])
                total[ids] += 1  # once for each distinct id, however often it is named
    seen = np.nonzero(total)[0]
    yield pd.DataFrame({"term": [*seen.tolist(), -1], "df": [*total[seen].tolist(), tokens]})


@dataclass
class Corpus:
    """What BM25 takes from all documents: document frequencies by term, number of documents, and mean length."""

    df: np.ndarray
    n: int
    mean: float

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Corpus:
        return cls(np.bincount(np.concatenate([*(np.unique(d) for d in docs), np.empty(0, np.int64)]).astype(np.int64)), len(docs), float(np.mean([len(d) for d in docs] or [0])))


class Bm25Shard:
    """An inverted index of the documents of one shard; docs: arrays of term ids."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        n = len(docs)
        size = np.array([len(d) for d in docs], np.int64)
        owner = np.repeat(np.arange(n), size)
        every = np.concatenate([*docs, np.array([], np.int64)]).astype(np.int64)
        held = np.bincount(every) > 0
        terms, place = np.nonzero(held)[0], (np.cumsum(held) - 1)[every]
        pairs, tf = np.unique(place * n + owner, return_counts=True)
        term, self.owner = pairs // n, pairs % n
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
        df = corpus.df[terms]
        idf = np.log(1 + (corpus.n - df + 0.5) / (df + 0.5))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.owner] / max(corpus.mean, 1)))
        by_doc = np.argsort(self.owner.astype(np.uint16) if n <= 1 << 16 else self.owner, kind="stable")
        self.terms_of = np.split(term[by_doc], np.cumsum(np.bincount(self.owner, minlength=n))[:-1])
        self.n = n

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document for the distinct terms of doc."""
        terms = self.terms_of[doc]
        start, length = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        total = int(length.sum())
        at = np.arange(total) + np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        return np.bincount(self.owner[at], self.weight[at], self.n)


def _best_first(score: np.ndarray, few: int = 16) -> Iterator[int]:
    """Places by falling score, the smaller first of equals; beyond the few best, which mostly do, the rest is sorted when it is asked for."""
    rest = np.arange(len(score))
    if len(score) > few:
        least = np.partition(score, len(score) - few)[len(score) - few]
        top, rest = np.nonzero(score >= least)[0], np.nonzero(score < least)[0]
        yield from top[np.argsort(-score[top], kind="stable")].tolist()
    yield from rest[np.argsort(-score[rest], kind="stable")].tolist()


def fill_windows(docs: list[np.ndarray], window: int, corpus: Corpus | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (doc, start, length) that use every id of docs once; only the last ones may be short, of power-of-two lengths."""
    index = Bm25Shard(docs, corpus or Corpus.of(docs))
    at = np.zeros(len(docs), np.int64)
    left = np.array([len(d) for d in docs], np.int64)
    out: list[list[tuple[int, int, int]]] = []
    while left.any():
        seed = int(np.argmax(left))
        pieces, room = [(seed, int(at[seed]), int(left[seed]))], window - int(left[seed])
        left[seed], at[seed] = 0, len(docs[seed])
        if room:
            score = np.where(left > 0, index.scores(seed), -1.0)
            for doc in _best_first(score):
                if not room or not left[doc]:
                    break
                take = int(min(room, left[doc]))
                pieces.append((doc, int(at[doc]), take))
                at[doc] += take
                left[doc] -= take
                room -= take
        out += [pieces] if not room else _powers(pieces, window - room)
    return out


def _powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces, of total ids, laid out as sequences whose lengths are powers of two, the longest first."""
    out, todo = [], list(pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        sequence = []
        while room:
            doc, start, length = todo.pop(0)
            take = min(room, length)
            sequence.append((doc, start, take))
            if take < length:
                todo.insert(0, (doc, start + take, length - take))
            room -= take
        out.append(sequence)
    return out


def _packed(rows: pd.DataFrame, window: int, corpus: Corpus, sequence: int) -> tuple[pd.DataFrame, int]:
    """The pieces of one shard, and the next free number of a sequence."""
    ids, tokens = rows["doc_id"].to_numpy(), rows["doc_tokens"].to_numpy()
    rests = [_ids(r, w) for r, w in zip(rows["rest"], rows["wide"], strict=True)]
    out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}

    def add(doc: int, start: int, length: int, crc: int, offset: int) -> None:
        for name, value in zip(out, (ids[doc], start, length, crc, tokens[doc], sequence, offset), strict=True):
            out[name].append(value)

    for doc, sums in enumerate(rows["sums"]):
        for k, crc in enumerate(sums):
            add(doc, k * window, window, int(crc), 0)
            sequence += 1
    for pieces in fill_windows(rests, window, corpus):
        offset = 0
        for doc, start, length in pieces:
            part = rests[doc][start : start + length].astype("<u4")
            add(doc, int(tokens[doc]) // window * window + start, length, zlib.crc32(part.tobytes()), offset)
            offset += length
        sequence += 1
    return pd.DataFrame(out), sequence


def _pack(window: int, shard_docs: int, shared):
    """Sorted rows to pieces, shard by shard; a number of a sequence starts with that of the task's part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence = TaskContext.get().partitionId() << 40
        held: list[pd.DataFrame] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            while held and (n := sum(map(len, held))) and (batch is None or n >= shard_docs):
                rows = pd.concat(held, ignore_index=True)
                held = [rows.iloc[shard_docs:]]
                pieces, sequence = _packed(rows.iloc[:shard_docs], window, shared.value, sequence)
                yield pieces

    return run


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece of a document (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = [f"key{k}" for k in range(KEYS)]
    schema = f"doc_id {kind}, doc_tokens long, sums array<long>, rest binary, wide boolean, " + ", ".join(f"{k} long" for k in keys)
    cut = stored(rows.mapInPandas(_cut(vocabulary, window, end_id), schema), "pack-cut")
    counted = {r["term"]: r["df"] for r in cut.select("rest", "wide").mapInPandas(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # one row for each term of the vocabulary
    tokens, n = counted.pop(-1, 0), cut.count()
    df = np.zeros(max(counted, default=0) + 1, np.int64)
    for term, many in counted.items():
        df[term] = many
    shared = spark.sparkContext.broadcast(Corpus(df, n, tokens / max(n, 1)))
    cut = cut.withColumn("row", F.monotonically_increasing_id())  # so that equal rows, too, can be in different parts
    order = [*keys, F.xxhash64("doc_id", "rest", "doc_tokens"), "row"]
    tasks = max(1, math.ceil(n / (shard_docs * TASK_SHARDS)))
    near = cut.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return near.mapInPandas(_pack(window, shard_docs, shared), schema)

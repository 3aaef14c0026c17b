"""Token counts of whole texts by finite-state transducers; see transducers.py for the machines.

Texts are handled in blocks of bounded size; a longer text goes through in several blocks, each from the last place where
the word cutter has certainly cut, so that no text has to fit in one block and none is shortened.

Defined results: a null or empty text has no bytes and no tokens; rows that repeat an id are counted each; an empty
table gives an empty result; a null id passes through; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.transducers import RESET, BpeCounter, character_classes, counter, word_cuts
from lectern.llm.wordhash import run_hashes
from lectern.session import ship_package

LIMIT = 1024
#: Characters handled at once.
BLOCK = 2_000_000


def _count_block(bpe: BpeCounter, text: str, resets: np.ndarray, owner_ends: np.ndarray | None) -> tuple[np.ndarray, int]:
    """Tokens by owner (owner k has the characters before owner_ends[k]); None: one, up to the place named next); resets: characters outside all pre-tokens. Also the last place where a pre-token certainly starts."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = character_classes()[points]
    classes[resets] = RESET
    starts = np.nonzero(word_cuts(classes))[0]
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    place = np.nonzero((data & 0xC0) != 0x80)[0]
    real = classes[starts] != RESET
    begin = place[starts]
    length = np.diff(begin, append=len(data))
    sure = starts[starts < len(points) - 1]  # a cut before the very last character may only stem from the end
    last = int(sure[-1]) if len(sure) else 0
    starts, begin, length = starts[real], begin[real], length[real]
    _, first, which = np.unique(run_hashes(data, begin, length), return_index=True, return_inverse=True)
    tokens = bpe.counts(data, begin[first], length[first])[which]
    sums = np.concatenate([[0], np.cumsum(tokens)])
    cut = np.searchsorted(starts, [0, last] if owner_ends is None else np.concatenate([[0], owner_ends]))
    return np.diff(sums[cut]), last


def count_tokens(bpe: BpeCounter, texts: list[str], block: int = BLOCK) -> np.ndarray:
    """The number of tokens of each text; special strings are one token each, as the library takes them by default."""
    out = np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        if len(texts[at]) > block:
            out[at] = _count_long(bpe, texts[at], block)
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= block:
            size += len(texts[end]) + 1
            end += 1
        some = texts[at:end]
        ends = np.cumsum([len(t) + 1 for t in some])
        joined = "\x00".join([*some, ""])
        special, found = _specials(bpe, joined)
        out[at:end] = _count_block(bpe, joined, np.concatenate([ends - 1, special]), ends)[0]
        if len(found):
            out[at:end] += np.bincount(np.searchsorted(ends, found, side="right"), minlength=len(some))
        at = end
    return out


def _specials(bpe: BpeCounter, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(their characters, their starts) of all special strings in text, leftmost first."""
    chars, starts = [], []
    for special in bpe.specials:
        at = text.find(special)
        while at >= 0:
            starts.append(at)
            chars += range(at, at + len(special))
            at = text.find(special, at + len(special))
    return np.array(chars, np.int64), np.array(starts, np.int64)


def _count_long(bpe: BpeCounter, text: str, block: int) -> int:
    special, found = _specials(bpe, text)
    total, at, size = len(found), 0, block
    while at < len(text):
        end = min(len(text), at + size)
        inside = special[(special >= at) & (special < end)] - at
        some = text[at:end]
        if end == len(text):
            return total + int(_count_block(bpe, some, inside, np.array([len(some)]))[0][0])
        count, last = _count_block(bpe, some, inside, None)
        if last == 0:  # one pre-token fills the block: take a larger one
            size *= 2
            continue
        total += int(count[0])
        at, size = at + last, block
    return total


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs (doc_id, text); vocabulary: a file that every machine has."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = counter(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": count_tokens(bpe, batch["text"].tolist())})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

"""Quality of documents by weak labels: overlapping heuristics vote, expectation-maximisation weighs them, a hashed scorer generalises.

Eight heuristics on length, words, letters, symbols, capitals and repetition each vote for good, for bad or not at all. The votes of
all documents are counted by pattern, and expectation-maximisation estimates from these counts how reliable each heuristic is and
how likely each pattern belongs to a good document. Those posteriors label a sample of some ``SAMPLE_DOCS`` documents (twice that at most,
those of the smallest hashes; of a text of more than ``SAMPLE_CHARS`` characters the piece that a hash points to), on which a logistic scorer of hashed features of the text (shapes of words, repeated neighbours, and
classes of length and variety) is trained. Every document is then scored on its whole text.

Defined results: a null text is empty; an empty text votes and scores by its length alone; rows that repeat an id are scored
each; a null id passes through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import WORD, hash_share
from lectern.session import ship_package

SAMPLE_DOCS, SAMPLE_CHARS = 4000, 32_768
BITS = 14
KEEP = 0.5


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def labellers(text: Column) -> dict[str, Column]:
    """Votes of the heuristics on a text that isn't null: 1 good, -1 bad, 0 none."""
    n = F.length(text)
    words = F.regexp_count(text, F.lit(WORD))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(n, F.lit(1))
    mean = n / F.greatest(words, F.lit(1))
    letters, symbols, capitals = share(r"\p{L}"), share(r"[#$%&*|!<>{}=~^\\]"), share(r"\p{Lu}")
    list_ = F.split(text, r"[\x20\x09-\x0D]+")
    variety = F.size(F.array_distinct(list_)) / F.size(list_)
    lines = F.split(text, "\n")
    line_variety = F.size(F.array_distinct(lines)) / F.size(lines)
    repeats = F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)\x20\1(?![^\x20\x09-\x0D])")) / F.greatest(words, F.lit(1))
    return {
        "length": _vote(words >= 30, words < 8),
        "mean": _vote(mean.between(4, 9), (mean < 3) | (mean > 14)),
        "letters": _vote(letters >= 0.75, letters < 0.6),
        "symbols": _vote(symbols < 0.005, symbols > 0.03),
        "capitals": _vote(capitals < 0.1, capitals > 0.3),
        "variety": _vote(variety >= 0.35, (variety < 0.12) & (words >= 50)),
        "lines": _vote((line_variety >= 0.8) & (F.size(lines) >= 4), (line_variety < 0.5) & (F.size(lines) >= 4)),
        "repeats": _vote(repeats < 0.02, repeats > 0.08),
    }


def posteriors(counts: dict[tuple[int, ...], int], rounds: int = 200) -> dict[tuple[int, ...], float]:
    """The probability of good for each pattern of votes, by expectation-maximisation over the numbers of documents."""
    if not counts:
        return {}
    x, n = np.array(list(counts)), np.array(list(counts.values()), float)
    vote = np.stack([x == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeller, vote
    post = np.clip(0.5 + x.sum(axis=1) / (2 * x.shape[1]), 0.02, 0.98)
    post = np.where(x.min(axis=1) < 0, np.minimum(post, 0.5), post)
    better = {1: np.array([0.5, 0.5, 2.0]), 0: np.array([2.0, 0.5, 0.5])}  # labellers are taken to be better than chance
    for _ in range(rounds):
        prior = (n @ post + 1) / (n.sum() + 2)
        log = []
        for y, p in ((1, post), (0, 1 - post)):
            rate = np.einsum("p,plv->lv", n * p, vote) + better[y]
            log.append(np.einsum("plv,lv->p", vote, np.log(rate / rate.sum(axis=1, keepdims=True))))
        gap = log[0] - log[1] + np.log(prior) - np.log(1 - prior)
        post = 1 / (1 + np.exp(-np.clip(gap, -40, 40)))
    return {k: float(p) for k, p in zip(counts, post, strict=True)}


_SHAPES = ((re.compile(r"[^\W\d_]", re.UNICODE), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"a+"), "a"))


class _Shapes(dict):
    """word -> hashed feature of its shape: letters and digits become one sign each, capitals and symbols stay."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        case = "U" if word.isupper() and len(word) > 1 else "l"
        shape = word
        for pattern, sign in _SHAPES:
            shape = pattern.sub(sign, shape)
        value = self[word] = zlib.crc32(f"{case}{shape[:24]}".encode()) & ((1 << BITS) - 1)
        return value


def document_features(text: str, shapes: dict) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, their values) of a text: shares of word shapes and of repeated neighbours, classes of length and variety."""
    words = text.split()
    mask = (1 << BITS) - 1
    n = len(words)
    extra = [f"n{min(n, 1 << 20).bit_length()}"]
    same = 0.0
    if n:
        extra.append(f"v{int(10 * len(set(words)) / n)}")
        extra.append(f"m{min(20, len(text) // n)}")
        same = sum(a == b for a, b in zip(words, words[1:])) / n  # noqa: B905
    ids, count = np.unique(np.fromiter(map(shapes.__getitem__, words), np.int64, n), return_counts=True)
    more = [zlib.crc32(e.encode()) & mask for e in extra] + [zlib.crc32(b"same") & mask]
    return np.concatenate([ids, more]), np.concatenate([np.sqrt(count / max(n, 1)), np.ones(len(extra)), [5 * np.sqrt(same)]])


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def score(self, text: str, shapes: dict) -> float:
        ids, value = document_features(text, shapes)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[ids] @ value, -40, 40))))


def fit_scorer(texts: list[str], good: list[float], rounds: int = 30) -> QualityModel:
    """A logistic scorer of hashed features, fitted to the probabilities `good` by steps of adaptive size."""
    weights, bias = np.zeros(1 << BITS), 0.0
    seen, seen_bias = np.full(1 << BITS, 1e-3), 1e-3
    shapes = _Shapes()
    cases = [document_features(t, shapes) for t in texts]
    order = np.random.default_rng(11)
    for _ in range(rounds):
        for k in order.permutation(len(cases)):
            ids, value = cases[k]
            err = 1 / (1 + np.exp(-np.clip(bias + weights[ids] @ value, -40, 40))) - good[k]
            g = err * value + 1e-5 * weights[ids]
            seen[ids] += g**2
            weights[ids] -= 0.1 * g / np.sqrt(seen[ids])
            seen_bias += err**2
            bias -= 0.1 * err / np.sqrt(seen_bias)
    return QualityModel(weights.astype(np.float32), float(bias))


def fitted(docs: DataFrame) -> QualityModel:
    """The scorer for docs: votes of all of them are counted, and a bounded sample is labelled with what the counts tell."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    votes = F.array(*[v.cast("int") for v in labellers(F.col("text")).values()])
    counts = {tuple(r["v"]): r["count"] for r in rows.select(votes.alias("v")).groupBy("v").count().collect()}  # at most 3**8 rows
    post = posteriors(counts)
    share = SAMPLE_DOCS / max(1, sum(counts.values()))
    order = F.xxhash64("doc_id", "text")
    begin = F.pmod(order, F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int")
    piece = F.substr("text", begin + 1, F.lit(SAMPLE_CHARS)).alias("text")
    sample = rows.filter(hash_share(share, "doc_id", "text")).select(order.alias("order"), piece, votes.alias("v"))
    sample = sample.orderBy("order", "text").limit(2 * SAMPLE_DOCS).collect()  # the limit is for rows that are all equal
    sample.sort(key=lambda r: zlib.crc32(r["text"].encode("utf-8", "surrogatepass")))
    return fit_scorer([r["text"] for r in sample], [post[tuple(r["v"])] for r in sample])


def score_quality(docs: DataFrame, model: QualityModel, keep: float = KEEP) -> DataFrame:
    """doc_id, score (the probability of good) and kept of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # 64 KB of weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = _Shapes()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [shared.value.score(t, shapes) for t in batch["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"doc_id {kind}, score double")
    return out.withColumn("kept", F.col("score") >= keep)

"""Toxic spans and documents by a linear-chain conditional random field.

The field has two tags, toxic and other. A token's potential is a sum of hashed weights of its word, beginnings and ending; the
chain adds weights for each change of tag. Labels are given for documents, so tokens of the training sample are labelled
first: a token of a toxic document is toxic if one of its features is found in many toxic documents, and in a far larger
share of them than of other documents. The field is fitted to these by gradient steps on the exact conditional likelihood, and
forward-backward gives every token's marginal. A document's score is a logistic function of
the summed evidence and of the strongest token, fitted on evidence that each half of the sample gets from a field fitted to the other; its spans are the runs of tokens whose marginal is above 1/2.

The fit uses a sample of some ``PER_CLASS`` labelled documents of each label (at most four times that in all), the ones of the smallest hashes, and
at most ``SAMPLE_CHARS`` characters of each: of a longer text the piece that a hash of its id points to. It learns from pieces of ``LANE`` tokens.
Scoring uses every token of every document, and forward-backward runs over the whole document: pieces of ``LANE`` tokens are handled
side by side, and what enters a piece from either side is carried through the product of the transitions of the pieces before it.

Defined results: null and empty texts, and texts without letters, have no tokens and the score of no evidence;
if the sample lacks one of the labels, every document scores the share of toxic labels in it (0 without labels); a null label is
no label, and of several labels of one id the largest counts; rows that repeat an id are scored each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import crc_mod, hash_share
from lectern.session import ship_package

FOLDS = 5
HELD_OUT_FOLD = 0
PER_CLASS = 1500
SAMPLE_CHARS = 32_768
LANE = 128
BITS = 18
#: A feature marks toxicity if it is found in so many toxic documents, in such a share of them, and in so many times the share of others.
LEAST_DOCS, LEAST_SHARE, LEAST_RATIO = 3, 0.02, 20.0
STEPS = 40

_LETTERS = re.compile(r"[^\W\d_]+")
_N_FEATURES = 6


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    mask = (1 << BITS) - 1
    found = [zlib.crc32(f"w{word}".encode()) & mask, zlib.crc32(f"s{word[-3:]}".encode()) & mask]
    return found + [zlib.crc32(f"{n}{word[:n]}".encode()) & mask if len(word) > n else found[0] for n in (3, 4, 5, 6)]


def words_of(text: str) -> list[str]:
    found = _LETTERS.findall(text)
    lower = "\n".join(found).lower().split("\n") if found else []
    return lower if len(lower) == len(found) else [w.lower() for w in found]


def _lanes(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position grid [lanes, LANE] with -1 as padding, document of each lane) for tokens of documents that end at `ends`."""
    sizes = np.diff(ends, prepend=0)
    lanes = -(-sizes // LANE)
    doc = np.repeat(np.arange(len(sizes)), lanes)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = (ends - sizes)[doc] + nth * LANE
    length = np.minimum(LANE, ends[doc] - start)
    grid = start[:, None] + np.arange(LANE)[None, :]
    grid[np.arange(LANE)[None, :] >= length[:, None]] = -1
    return grid, doc


def _carried(first: np.ndarray, out: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Odds that enter each lane, in the order of the lanes: `first` where a document starts, else what leaves the lane before.

    out: odds that leave lanes where a document starts; steps [4, lanes]: what leaves is (a r + b) / (c r + d) where r enters.
    """
    starts = np.nonzero(first)[0]
    many = np.diff(starts, append=len(first))
    enters = np.ones(len(first))
    live, now = starts[many > 1], out[starts[many > 1]]
    many = many[many > 1]
    for k in range(1, int(many.max(initial=0))):
        keep = many > k
        live, now, many = live[keep], now[keep], many[keep]
        at = live + k
        enters[at] = now
        a, b, c, d = steps[:, at]
        now = (a * now + b) / (c * now + d)
    return enters


def _product(weight: np.ndarray, p: float, q: float, r: float, s: float, ahead: bool) -> np.ndarray:
    """The four numbers of the whole lane's step, from those of its tokens: w (p x + q) / (r x + s) ahead, (p w x + q) / (r w x + s) back."""
    a, b, c, d = np.ones(len(weight)), np.zeros(len(weight)), np.zeros(len(weight)), np.ones(len(weight))
    for t in range(LANE) if ahead else range(LANE - 1, -1, -1):
        w = weight[:, t]
        if ahead:
            a, b, c, d = w * (p * a + q * c), w * (p * b + q * d), r * a + s * c, r * b + s * d
        else:
            a, b, c, d = p * w * a + q * c, p * w * b + q * d, r * w * a + s * c, r * w * b + s * d
        size = a + b + c + d
        a, b, c, d = a / size, b / size, c / size, d / size
    return np.stack([a, b, c, d])


def forward_backward(unary: np.ndarray, grid: np.ndarray, stay: float, enter: float, leave: float, doc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal log-odds of toxic [lanes, LANE], and the forward and backward log-odds they are made of.

    Potentials are relative to the other tag: unary for the token, and stay, enter and leave for the pairs toxic-toxic,
    other-toxic and toxic-other. doc: the document of each lane; lanes of one document stand in order and are one chain (None: every lane
    is a chain).
    """
    doc = np.arange(len(grid)) if doc is None else doc
    first, last = np.diff(doc, prepend=-1) != 0, np.diff(doc, append=-1) != 0
    real = grid >= 0
    w = np.exp(np.clip(np.where(real, unary[grid], 0.0), -40, 40))
    p, e, q = math.exp(stay), math.exp(enter), math.exp(leave)
    fore, back = np.empty_like(w), np.ones_like(w)

    def ahead(enters: np.ndarray, some: np.ndarray) -> None:
        """Forward odds of some lanes into `fore`."""
        x, y = w[some], np.empty((len(some), w.shape[1]))
        y[:, 0] = np.where(first[some], x[:, 0], x[:, 0] * (p * enters + e) / (q * enters + 1))
        for t in range(1, x.shape[1]):
            y[:, t] = x[:, t] * (p * y[:, t - 1] + e) / (q * y[:, t - 1] + 1)
        fore[some] = y

    every = np.arange(len(grid))
    if first.all():
        ahead(np.ones(len(grid)), every)
    else:
        ahead(np.ones(first.sum()), every[first])
        steps = np.ones((4, len(grid)))
        inner = ~first & ~last
        steps[:, inner] = _product(w[inner], p, e, q, 1.0, ahead=True)
        enters = _carried(first, fore[:, -1], steps)
        ahead(enters[~first], every[~first])

    def backward(enters: np.ndarray, some: np.ndarray) -> None:
        """Backward odds of some lanes into `back`; enters: the backward odds of the last token."""
        x, y, there = w[some], np.ones((len(some), w.shape[1])), real[some]
        y[:, -1] = enters
        for t in range(w.shape[1] - 2, -1, -1):
            r = x[:, t + 1] * y[:, t + 1]
            y[:, t] = np.where(there[:, t + 1], (p * r + q) / (e * r + 1), 1.0)
        back[some] = y

    if last.all():
        backward(np.ones(len(grid)), every)
    else:
        backward(np.ones(last.sum()), every[last])
        # what a lane hands to the one before it: the backward odds of that lane's last token
        hand = (p * w[:, 0] * back[:, 0] + q) / (e * w[:, 0] * back[:, 0] + 1)
        steps = np.ones((4, len(grid)))
        inner = ~first & ~last
        steps[:, inner] = _product(w[inner], p, q, e, 1.0, ahead=False)
        enters = _carried(last[::-1], hand[::-1], steps[:, ::-1])[::-1]
        backward(enters[~last], every[~last])
    fore, back = np.log(fore), np.log(back)
    return fore + back, fore, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class ToxicModel:
    """A fitted field: weights by hashed feature, bias, tag changes, and the document's logistic (or a constant)."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = -6.0
    chain: tuple[float, float, float] = (0.0, 0.0, 0.0)
    logistic: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None

    def unary(self, word: str) -> float:
        return self.bias + float(self.weights[features(word)].sum())

    def marginals(self, unary: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-odds of toxic for each token of documents that end at `ends`."""
        out = np.empty(len(unary))
        grid, doc = _lanes(ends)
        at = 0
        while at < len(grid):  # whole documents at a time
            to = int(np.searchsorted(doc, doc[min(at + 4096, len(doc)) - 1], side="right"))
            some = grid[at:to]
            odds = forward_backward(unary, some, *self.chain, doc[at:to])[0]
            out[some[some >= 0]] = odds[some >= 0]
            at = to
        return out

    @staticmethod
    def evidence(odds: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Two features of each document: the log of the summed evidence, and its strongest token's log-odds."""
        starts = np.concatenate([[0], ends[:-1]])
        some = ends > starts
        total, top = np.zeros(len(ends)), np.full(len(ends), -12.0)
        if some.any():
            at = starts[some]
            total[some] = np.add.reduceat(np.logaddexp(0, np.clip(odds, -30, 30)), at)
            top[some] = np.maximum.reduceat(np.clip(odds, -12, 12), at)
        return np.stack([np.ones(len(ends)), np.log(total + 1e-4), top], axis=1)

    def scores(self, odds: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(ends), self.constant)
        return _sigmoid(self.evidence(odds, ends) @ np.array(self.logistic))


def _near_copy_keys(words: list[str]) -> list[tuple]:
    """Four groups of four smallest hashes of neighbouring words; near copies share one of them, other documents hardly ever."""
    h = np.array([zlib.crc32(f"{a} {b}".encode()) for a, b in {*zip(words, words[1:])}] or [zlib.crc32(" ".join(words).encode())], np.uint64)  # noqa: B905
    mins = [int(((h * np.uint64(2 * m + 0x9E3779B1)) & np.uint64(0xFFFFFFFF)).min()) for m in range(16)]
    return [(m, *mins[m : m + 4]) for m in range(0, 16, 4)]


def fit_toxicity(texts: list[str], toxic: list[int], steps: int = STEPS) -> ToxicModel:
    """The field and the documents' logistic, fitted to labelled documents; of near copies the first counts."""
    seen: set[tuple] = set()
    ids: dict[str, int] = {}
    tokens, kept = [], []
    for text, bad in zip(texts, toxic, strict=True):
        words = words_of(text)
        keys = _near_copy_keys(words)
        if not any(key in seen for key in keys):
            tokens.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)))
            kept.append(bool(bad))
        seen.update(keys)
    label = np.array(kept, bool)
    if not label.any() or label.all():
        return ToxicModel(constant=float(sum(toxic)) / max(len(toxic), 1))
    feats = np.array([features(w) for w in ids] or [[0] * _N_FEATURES], np.int32)
    del ids, seen
    model = _fit_field(tokens, feats, label, steps)
    half = np.arange(len(tokens)) % 2 == 0
    x = np.empty((len(tokens), 3))
    for side in (half, ~half):
        other = [w for w, s in zip(tokens, side, strict=True) if not s]
        field_ = _fit_field(other, feats, label[~side], steps) if label[~side].any() else model
        some = [w for w, s in zip(tokens, side, strict=True) if s]
        ends = np.cumsum([len(w) for w in some], dtype=np.int64)
        by_word = field_.weights[feats].sum(axis=1) + field_.bias
        x[side] = field_.evidence(field_.marginals(by_word[np.concatenate(some)], ends), ends)
    coef = np.zeros(3)
    for _ in range(30):
        p = _sigmoid(x @ coef)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        coef += np.linalg.solve(hess, x.T @ (label - p) - 0.05 * coef)
    model.logistic = tuple(float(c) for c in coef)
    return model


def _fit_field(tokens: list[np.ndarray], feats: np.ndarray, label: np.ndarray, steps: int) -> ToxicModel:
    """Weights of the field; tokens: word ids of documents, feats: each word's features, label: whether each document is toxic."""
    size = 1 << BITS
    seen = np.zeros((2, size))
    for words, bad in zip(tokens, label, strict=True):
        seen[int(bad), np.unique(feats[np.unique(words)])] += 1
    n_other, n_toxic = max((~label).sum(), 1), label.sum()
    marks = (seen[1] >= max(LEAST_DOCS, LEAST_SHARE * n_toxic)) & (seen[1] / n_toxic >= LEAST_RATIO * (seen[0] + 0.5) / n_other)
    marked = marks[feats].any(axis=1)

    ends = np.cumsum([len(w) for w in tokens])
    word = np.concatenate(tokens)
    truth = marked[word] & np.repeat(label, [len(w) for w in tokens])
    grid = _lanes(ends)[0].astype(np.int32)
    # chains without a toxic token are alike: four times as many as there are others are enough to fit on
    bad = np.where(grid >= 0, truth[grid], False).any(axis=1)
    rest = np.random.default_rng(7).permutation(np.nonzero(~bad)[0])[: max(2000, 4 * bad.sum())]
    grid = grid[np.concatenate([np.nonzero(bad)[0], rest]).astype(int)]
    model = ToxicModel()
    params = np.concatenate([np.zeros(size), [model.bias], [0.0, 0.0, 0.0]])
    first, second = np.zeros_like(params), np.zeros_like(params)
    n = (grid >= 0).sum()
    for step in range(1, steps + 1):
        unary = (params[feats].sum(axis=1) + params[size])[word]
        grad, by_word = np.zeros_like(params), np.zeros(len(feats))
        for at in range(0, len(grid), 2048):
            _add_gradient(grid[at : at + 2048], unary, truth, word, params[size + 1 :], by_word, grad[size:])
        np.add.at(grad, feats, by_word[:, None])
        grad = grad / n * 1000 + 1e-4 * params
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        params -= 0.25 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    model.weights, model.bias, model.chain = params[:size].astype(np.float32), float(params[size]), tuple(float(x) for x in params[size + 1 :])
    return model


def _add_gradient(grid: np.ndarray, unary: np.ndarray, truth: np.ndarray, word: np.ndarray, chain: np.ndarray, by_word: np.ndarray, other: np.ndarray) -> None:
    """Add the gradient of some chains to by_word (of words) and other (bias, stay, enter, leave)."""
    stay, enter, leave = chain
    odds, fore, back = forward_backward(unary, grid, stay, enter, leave)
    real = grid >= 0
    y = np.where(real, truth[grid], False)
    off = (_sigmoid(odds) - y)[real]
    by_word += np.bincount(word[grid[real]], off, len(by_word))
    other[0] += off.sum()
    later = back[:, 1:] + np.where(real, unary[grid], 0.0)[:, 1:]
    now = fore[:, :-1]
    joint = np.stack([now + stay + later, enter + later, now + leave, np.zeros_like(now)])
    joint = np.exp(joint - joint.max(axis=0))
    joint /= joint.sum(axis=0)
    a, b = y[:, :-1], y[:, 1:]
    for k, hit in enumerate((a & b, ~a & b, a & ~b)):
        other[1 + k] += (joint[k] - hit)[real[:, 1:]].sum()


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(text, toxic) of some per_class labelled documents of each label, picked by a hash of their ids, none of them held out."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(crc_mod("doc_id", FOLDS) != HELD_OUT_FOLD)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    wanted = [(F.col("toxic") == t) & hash_share(1.25 * per_class / max(1, counts.get(t, 0)), "doc_id") for t in (0, 1)]
    first = [F.xxhash64(F.col("doc_id"), F.lit(1)), F.col("doc_id")]
    ids = F.broadcast(known.filter(wanted[0] | wanted[1]).orderBy(*first).limit(4 * per_class))  # rows of two numbers
    begin = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - most_chars, F.lit(0)) + 1).cast("int")
    piece = F.substr("text", begin + 1, F.lit(most_chars)).alias("text")
    some = docs.select("doc_id", "text").filter("text IS NOT NULL").join(ids, "doc_id").select("doc_id", piece, "toxic")
    return some.orderBy(*first, F.xxhash64("text")).limit(4 * per_class)  # the limit is for ids that are repeated


def _score(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: ToxicModel = shared.value

        class Known(dict):
            def __missing__(self, word: str) -> float:
                if len(self) > 300_000:
                    self.clear()
                value = self[word] = model.unary(word)
                return value

        known = Known()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = batch.iloc[at : at + 1000]
                unary, ends = [], []
                for text in some["text"]:
                    words = words_of(text)
                    unary.append(np.fromiter(map(known.__getitem__, words), np.float64, len(words)))
                    ends.append(len(words))
                ends = np.cumsum(ends)
                odds = model.marginals(np.concatenate(unary), ends)
                spans = [_spans(t, odds[e - len(u) : e]) for t, u, e in zip(some["text"], unary, ends, strict=True)]
                yield pd.DataFrame({"doc_id": some["doc_id"], "score": model.scores(odds, ends), "spans": spans})

    return run


def _spans(text: str, odds: np.ndarray) -> list[dict[str, int]]:
    """Start and end of each run of tokens that are more likely toxic than not."""
    bad = odds > 0
    if not bad.any():
        return []
    out, last = [], -2
    for k, m in enumerate(_LETTERS.finditer(text)):
        if bad[k]:
            if last == k - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = k
    return out


def fitted(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    sample = sorted(training_sample(docs, labels).collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"]))
    return fit_toxicity([r["text"] for r in sample], [r["toxic"] for r in sample])


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (code points, end exclusive) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # 1 MB of weights
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInPandas(_score(shared), f"doc_id {kind}, score double, spans array<struct<start: int, end: int>>")
    held = crc_mod("doc_id", FOLDS) == HELD_OUT_FOLD
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of docs that the model doesn't reject, with their own columns."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = _score(shared)
        for part in parts:
            frame = pd.DataFrame({"doc_id": 0, "text": part.fillna("")})
            yield pd.concat([x["score"] for x in run([frame])]) if len(frame) else pd.Series([], dtype=float)

    return docs.filter(score(docs["text"]) < 0.5)

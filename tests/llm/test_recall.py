"""Recall of the joins against brute force: documents of the standard tables, and planted vectors at the threshold."""

import random

import numpy as np

from lectern.llm import blocks, near_vectors, ngram_join
from lectern.llm.queries import table


def test_ngram_links_of_the_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    sets = {d["doc_id"]: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := d["text"].split()) else set() for d in docs.collect()}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in holders.values() if len(ids) < 200 for a in ids for b in ids if a < b}
    near = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    n_links = dict.fromkeys(sets, 0)
    for a, b in near:
        n_links[a] += 1
        n_links[b] += 1
    found = {r["doc_id"]: r["n_links"] for r in ngram_join.near_texts(docs).collect()}
    assert len(near) > 100 and all(found[i] <= n for i, n in n_links.items())
    assert sum(found.values()) >= 0.99 * sum(n_links.values())


def test_planted_vectors_at_the_threshold(spark):
    rng = np.random.default_rng(21)
    n, dim = 5000, 32
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(1500, dim))
    side -= (side * x[:1500]).sum(axis=1, keepdims=True) * x[:1500]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = np.where(np.arange(1500) % 3 > 0, 0.9501, 0.9499)
    x = np.concatenate([x, cos[:, None] * x[:1500] + np.sqrt(1 - cos[:, None] ** 2) * side])
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    near = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :] >= 0.95
    links = near.sum(axis=1) - 1
    assert links.sum() >= 2000 and all(found[k][0] <= links[k] for k in range(len(x)))
    assert sum(f[0] for f in found.values()) >= 0.99 * links.sum()


def test_trie_pairs_tell_who_hangs_together():
    """Against all pairs that share a prefix of the shortest length: the same groups, fewer comparisons."""
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randint(2, 60)
        labels = np.array([[rng.randrange(2) for _ in range(6)] for _ in range(n)])
        like = np.array([[rng.random() < 0.3 for _ in range(n)] for _ in range(n)])
        like |= like.T
        asked = []

        def alike(a, b, like=like, asked=asked):
            asked.extend(zip(a.tolist(), b.tolist(), strict=True))
            return like[a, b]

        apart = np.array([rng.randrange(2) for _ in range(n)]) if rng.random() < 0.5 else None
        a, b = ngram_join.trie_pairs(labels, 2, alike, apart)
        meet = [(i, j) for i in range(n) for j in range(i) if (labels[i, :2] == labels[j, :2]).all() and like[i, j] and (apart is None or apart[i] != apart[j])]
        x, y = (np.array(k, int) for k in zip(*meet, strict=True)) if meet else (np.empty(0, int), np.empty(0, int))
        assert blocks.linked_roots(n, a, b).tolist() == blocks.linked_roots(n, x, y).tolist()
        assert len({frozenset(p) for p in asked}) == len(asked)

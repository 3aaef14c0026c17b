"""Operators against brute force, DuckDB or exact round trips."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import blocks, components, lm_scoring, mixing, near_vectors, ngram_join, packing, pii, quality, token_counts, topk, toxicity
from lectern.llm.queries import ORACLES, QUERIES, table
from lectern.llm.transducers import counter
from tests.conftest import SF_SMALL
from tests.oracle import connection, same

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    same(QUERIES[name](spark, SF_SMALL), connection(SF_SMALL), ORACLES[name])


def test_mix_comes_near_its_targets(spark):
    rows = [(k, "w " * (1 + (k * 7919) % 200), "big" if k % 3 else f"s{k % 5}") for k in range(3000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    targets, taken = {}, collections.Counter()
    for r in plan:
        assert r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] + 1e-6
        targets[r["source_size"], round(r["target"], 6)] = r["target"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert all(abs(taken[k] - t) <= 200 for k, t in targets.items())
    assert math.isclose(sum(targets.values()), 1.5 * sum(r["size"] for r in plan))
    again = mixing.mix_plan(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert {(r["doc_id"], r["copies"]) for r in again} == {(r["doc_id"], r["copies"]) for r in plan}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {x: root(x) for x in parent}


def test_near_vectors_with_a_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 64)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    x = np.concatenate([centre + 0.05 * rng.normal(size=(300, 16)), rng.normal(size=(200, 16)), np.repeat(rng.normal(size=(1, 16)), 50, axis=0)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(df).collect()}
    a, b = np.nonzero(near)
    label = blocks.linked_roots(len(x), a, b)
    assert [found[k][0] for k in range(len(x))] == (near.sum(1) - 1).tolist()
    assert [found[k][1] for k in range(len(x))] == label.tolist()


def test_ngram_join_with_crowded_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(120)]
        for copy in range(60 if base == 0 else 4):
            t = list(text)
            for _ in range(copy % 5):
                t[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(t))
    texts += ["a b", "a  b", "a b c", "", " "]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]
    n = len(texts)
    near = np.array([[bool(s and u) and len(s & u) >= 0.8 * len(s | u) for u in sets] for s in sets])
    a, b = np.nonzero(near)
    label = blocks.linked_roots(n, a, b)
    found = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngram_join.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[k][0] for k in range(n)] == [max(0, int(c) - 1) for c in near.sum(1)]
    assert [found[k][1] for k in range(n)] == label.tolist()


def test_shortest_prefix_reaches_the_recall():
    assert ngram_join.shortest_prefix(0.8) == 4 and ngram_join.shortest_prefix(0.99) == ngram_join.DEPTH
    for threshold in (0.5, 0.7, 0.8, 0.9):
        depth = ngram_join.shortest_prefix(threshold)
        assert depth == 1 or 1 - (1 - threshold**depth) ** ngram_join.TREES >= ngram_join.RECALL


PIECES = ["a", "e", "'", "s", "t", "re", "ve", "'ll", "'d", " ", "  ", "\n", "\t", "1", "23", "!", "?", "é", "ß", "日本", "　", "\x85", "😀", "<|endoftext|>", "'r", "'v", "'l", "L", "the", "ing", "\xa0", "x" * 5, "½", "́", "\r\n"]


def test_tokens_like_the_library():
    rng = random.Random(1)
    texts = ["", "'r", "'re", "a'", " "] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    library = Tokenizer.from_file(VOCABULARY)
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_tokens(counter(VOCABULARY), texts).tolist() == expected
    long = "".join(rng.choice(PIECES) for _ in range(20_000)) + "a" * 3000
    assert token_counts.count_tokens(counter(VOCABULARY), [long], block=300).tolist() == [len(library.encode(long, add_special_tokens=False).ids)]


def test_packing_draws_the_hashes_of_a_term_once(monkeypatch):
    """Minimum hashes come from a table of terms: hashes are drawn for new terms alone, and the keys are those of the definition."""
    rng = np.random.default_rng(4)
    docs = [rng.zipf(1.3, 400).clip(max=49_999).astype("<u4") for _ in range(30)]
    packing.likeness_keys(np.array([49_999], "<u4"))
    drawn, mix = [], packing.mix
    monkeypatch.setattr(packing, "mix", lambda h: (drawn.append(len(h)), mix(h))[1])
    found = [packing.likeness_keys(ids) for ids in docs]
    assert not drawn
    for ids, keys in zip(docs, found, strict=True):
        terms = np.unique(ids).astype(np.uint64)
        for k, key in enumerate(keys):
            u = (mix(terms + np.uint64((k + 1) << 40)) >> np.uint64(11)).astype(float) / 2**53
            best = np.argmin(-np.log(u) / np.maximum(np.log1p(terms.astype(float) / 256), 1e-6))
            assert key == int(mix(terms[best : best + 1])[0] >> np.uint64(33))


def test_packing_neighbours_come_in_the_order_of_a_whole_sort():
    rng = np.random.default_rng(5)
    for n in (0, 1, 16, 17, 500):
        score = rng.integers(-1, 6, n).astype(float)
        assert list(packing._best_first(score)) == np.argsort(-score, kind="stable").tolist()


def test_packing_round_trip(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = packing.pack_documents(docs, VOCABULARY).collect()
    library = Tokenizer.from_file(VOCABULARY)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d in docs.collect():
        ids = np.array([*library.encode(d["text"], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[d["doc_id"]], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_neighbours_fill_a_window():
    docs = [np.arange(k * 100, k * 100 + 60) for k in range(6)] + [np.arange(0, 50)]
    first = packing.fill_windows(docs, 110)[0]
    assert [p[0] for p in first] == [0, 6]


def test_likeness_keys_follow_what_is_shared():
    rng = np.random.default_rng(3)
    same = other = 0
    for _ in range(300):
        a, b = rng.choice(40_000, (2, 100), replace=False)
        near = np.concatenate([a[:80], b[:20]])
        same += packing.likeness_keys(a)[0] == packing.likeness_keys(near)[0]
        other += packing.likeness_keys(a)[0] == packing.likeness_keys(b)[0]
    assert same > 150 and other < 10  # they share 80 of 120 ids


def test_base_score_and_bits(spark):
    docs = table(spark, SF_SMALL, "documents")
    word = re.compile(r"[^\x20\x09-\x0D]+")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {d["doc_id"]: [*word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), d["text"])), "\n"] for d in docs.collect()}
    counts = collections.Counter(t for i, ts in tokens.items() if not held(i) for t in ts)
    total = math.log10(sum(counts.values()) + len(counts) + 1)
    for r in lm_scoring.score_texts(docs).collect():
        ts = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(ts), sum(t in counts for t in ts), sum(counts.values()))
        assert math.isclose(r["base_score"], sum(math.log10(counts[t] + 1) - total for t in ts), rel_tol=1e-9)
        assert r["score"] < 0


def test_toxic_spans(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(300)]
    rows = []
    for k in range(600):
        text = [rng.choice(words) for _ in range(60)]
        if k % 4 == 0:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["Vile", "vilest", "nasty"])
        rows.append((k, " ".join(text), int(k % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fitted(df, df.select("doc_id", "toxic"))
    out = toxicity.score_toxicity(df, model).collect()
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)
    for r in held[:50]:
        found = {rows[r["doc_id"]][1][s["start"] : s["end"]].lower() for s in r["spans"]}
        assert all(set(f.split()) <= {"vile", "vilest", "nasty"} for f in found)
    assert toxicity.drop_toxic(df, model).count() == sum(r["score"] < 0.5 for r in out)


def chain_odds(u, stay, enter, leave):
    """Marginal log-odds token by token, in logarithms."""
    n = len(u)
    fore, back = np.empty(n), np.zeros(n)
    for k in range(n):
        fore[k] = u[k] + (np.logaddexp(fore[k - 1] + stay, enter) - np.logaddexp(fore[k - 1] + leave, 0) if k else 0)
    for k in range(n - 2, -1, -1):
        r = back[k + 1] + u[k + 1]
        back[k] = np.logaddexp(stay + r, leave) - np.logaddexp(enter + r, 0)
    return fore + back


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(8)
    u, (stay, enter, leave) = rng.normal(size=5), rng.normal(size=3)
    weight = np.zeros((5, 2))
    for path in range(32):
        y = [path >> k & 1 for k in range(5)]
        score = sum(u[k] for k in range(5) if y[k]) + sum({(1, 1): stay, (0, 1): enter, (1, 0): leave, (0, 0): 0}[y[k], y[k + 1]] for k in range(4))
        for k in range(5):
            weight[k, y[k]] += math.exp(score)
    odds = np.log(weight[:, 1] / weight[:, 0])
    assert np.allclose(chain_odds(u, stay, enter, leave), odds)
    assert np.allclose(toxicity.ToxicModel(chain=(stay, enter, leave)).marginals(u, np.array([5])), odds)


def test_chains_are_whole_documents():
    rng = np.random.default_rng(9)
    sizes = [0, 1, 127, 128, 129, 256, 0, 300, 1000, 5]
    u = rng.normal(scale=3, size=sum(sizes))
    chain = (2.5, -3.0, -2.0)
    ends = np.cumsum(sizes)
    expected = np.concatenate([chain_odds(u[e - n : e], *chain) for e, n in zip(ends, sizes, strict=True)])
    assert np.allclose(toxicity.ToxicModel(chain=chain).marginals(u, ends), expected)


def test_weak_labels_like_plain_expectation_maximisation():
    """posteriors() on counts by pattern against the same estimate document by document."""
    rng = random.Random(3)
    votes = []
    for _ in range(300):
        good = rng.random() < 0.7
        votes.append(tuple(rng.choice([1 if good else -1] * 4 + [0, 1, -1]) for _ in range(8)))
    found = quality.posteriors(collections.Counter(votes))
    post = [min(0.98, max(0.02, 0.5 + sum(v) / 16)) for v in votes]
    post = [min(p, 0.5) if min(v) < 0 else p for p, v in zip(post, votes, strict=True)]
    for _ in range(200):
        prior = (sum(post) + 1) / (len(votes) + 2)
        rate = {}
        for y in (0, 1):
            for j in range(8):
                w = {-1: 2.0 if y == 0 else 0.5, 0: 0.5, 1: 2.0 if y == 1 else 0.5}
                for v, p in zip(votes, post, strict=True):
                    w[v[j]] += p if y else 1 - p
                rate[y, j] = {k: x / sum(w.values()) for k, x in w.items()}
        log = [[math.log(p) + sum(math.log(rate[y, j][v[j]]) for j in range(8)) for y, p in ((0, 1 - prior), (1, prior))] for v in votes]
        post = [1 / (1 + math.exp(min(40, max(-40, a - b)))) for a, b in log]
    assert all(math.isclose(found[v], p, abs_tol=1e-6) for v, p in zip(votes, post, strict=True))


def test_votes_and_scores_of_whole_documents(spark):
    """The query's votes and scores against plain Python on every document."""
    docs = table(spark, SF_SMALL, "documents")
    texts = {d["doc_id"]: d["text"] for d in docs.collect()}
    model = quality.fitted(docs)
    found = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    for i, text in texts.items():
        words = text.split()
        ids = collections.defaultdict(float)
        for w in words:
            ids[quality._Shapes()[w]] += 1 / len(words)
        z = model.bias + sum(model.weights[k] * math.sqrt(v) for k, v in ids.items())
        mask = (1 << quality.BITS) - 1
        more = [f"n{len(words).bit_length()}"] + ([f"v{int(10 * len(set(words)) / len(words))}", f"m{min(20, len(text) // len(words))}"] if words else [])
        z += sum(model.weights[zlib.crc32(m.encode()) & mask] for m in more)
        same = sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1)  # noqa: B905
        z += model.weights[zlib.crc32(b"same") & mask] * 5 * math.sqrt(same)
        assert math.isclose(found[i]["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-4) and found[i]["kept"] == (found[i]["score"] >= quality.KEEP)
    votes = {r["doc_id"]: r["v"] for r in docs.select("doc_id", F.create_map(*[x for k, v in quality.labellers(F.col("text")).items() for x in (F.lit(k), v)]).alias("v")).collect()}
    for i, text in texts.items():
        words, n = re.findall(r"[^\x20\x09-\x0D]+", text), len(text)
        mean, lines = n / max(1, len(words)), text.split("\n")
        assert votes[i]["length"] == (-1 if len(words) < 8 else 1 if len(words) >= 30 else 0)
        assert votes[i]["mean"] == (-1 if mean < 3 or mean > 14 else 1 if 4 <= mean <= 9 else 0)
        share = len(set(lines)) / len(lines)
        assert votes[i]["lines"] == (0 if len(lines) < 4 else -1 if share < 0.5 else 1 if share >= 0.8 else 0)


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    out = quality.score_quality(docs, quality.fitted(docs)).join(table(spark, sf, "labels"), "doc_id").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in out) >= 0.95 * len(out)
    good = [r for r in out if r["quality"] == 1]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return [f"{BASE[k][0]}:{s}:{e}" for s, k, e in sorted(out)]


def test_base_spans(spark):
    rng = random.Random(9)
    parts = ["a@b.c", "@", "d@e.f_g@h.i", "1.2.3.4", "256.1.1.1", "001.002.3.255", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "-", " ", "+1 (504) 555-2652", "+", "(", "7", "12 34", "é", "😀", "x", "%", "..", "\n", "+49 170 1234567."]
    texts = [None, "", "9" * 200, "a" * 5000 + "@b.com"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(1500)] + [" ".join(["a@b.c 1.2.3.4"] * 300)]
    found = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        spans = base_spans(text or "")
        assert found[k]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), text
        assert [found[k][f"n_{kind}"] for kind, _ in BASE] == [sum(s.startswith(kind) for s in spans) for kind, _ in BASE]
        assert set(spans) <= set(found[k]["spans"].split(",")) or not spans


def test_redaction_changes_nothing_else(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org now", 16), (2, "nothing here", 12), (3, None, None)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redacted(docs).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] now", 16), (2, "nothing here", 12), (3, None, None)]


def best_rows(ids, x, asked, k=5):
    """Brute force over Python's whole numbers."""
    out = {}
    for i in asked:
        score = {j: sum(a * b for a, b in zip(x[j], x[i], strict=True)) for j in range(len(x)) if ids[j] != ids[i] and len(x[j]) == len(x[i])}
        out[ids[i]] = [(ids[j], score[j]) for j in sorted(score, key=lambda j: (-score[j], ids[j]))[:k]]
    return out


def test_top_inner_products_prune_but_miss_nothing():
    rng = np.random.default_rng(10)
    x = rng.integers(-20, 20, size=(900, 8)).astype(float)
    x[100:300] = x[100]
    at, found, score = topk.Shard(np.arange(900), x).search(np.arange(0, 900, 50), x[::50], np.full(18, topk.LOW - 1), 5)
    for k, (i, best) in enumerate(best_rows(range(900), x.tolist(), range(0, 900, 50)).items()):
        assert i == 50 * k and list(zip(found[at == k].tolist(), score[at == k].tolist(), strict=True)) == best


@pytest.mark.parametrize("shard", [50, 100_000])
def test_top_inner_products_over_rounds(spark, monkeypatch, shard):
    """Ties across shards, all rounds, large components, and columns of clashing names."""
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    x = rng.integers(-4, 5, size=(1500, 6)) / 256.0
    x[rng.integers(0, 1500, 200)] = x[0]
    x = [*x.tolist(), [1048577.0, 1.0, 0.0, 0.0, 0.0, 0.5], [1e30, -1.0, 0.0, 0.0, 0.0, 0.0], [], [], [3.0]]
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v, 0, 1.0, 2, 3, 4, 5) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, id int, x double, cell int, query int, dim int, salt int")
    asked = F.col("vec_id").isin(*range(0, 1500, 50), 1500, 1502)
    found = collections.defaultdict(list)
    for r in topk.top_inner_products(df, asked).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = [[math.floor(256 * v) for v in row] for row in x]
    clipped = {i: [(j, max(topk.LOW, min(topk.HIGH, s))) for j, s in best] for i, best in best_rows(ids, whole, [*range(0, 1500, 50), 1500, 1502]).items()}
    assert dict(found) == clipped


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF_SMALL, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF_SMALL).cache()
        assert docs.columns == columns and docs.count() > 0
        if name in ("toxicity", "near-duplicates"):
            assert docs.count() == docs.select("doc_id").distinct().count() <= before.count()
    assert corpus_pipeline.run(spark, SF_SMALL).count() > 0

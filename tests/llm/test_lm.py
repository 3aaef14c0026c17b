"""The language model against a token-by-token form of it, and what a probability has to satisfy."""

import collections
import math
import random

import numpy as np
import pandas as pd

from lectern.llm import context_mixing as cm
from lectern.llm import lm_scoring
from lectern.llm.queries import table
from tests.conftest import SF_SMALL


def corpus(seed=3, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(0, 250))]
        if k % 5 == 0:
            text[10:10] = passage
        out.append(" ".join(text))
    return [*out, "", "  ", "One ONE one", "x" * 3000]


def counted(texts, learnt):
    """What the model holds of the learnt texts, by dictionaries."""
    tokens = cm.Tokens([t.encode() for t in texts])
    centres = cm.first_centres(cm.kind_vectors(tokens)[learnt])
    own = np.argmax(cm.kind_vectors(tokens) @ centres.T, axis=1)
    text, _ = tokens.places()
    kinds = np.zeros((cm.KINDS, len(tokens.keys)), np.int64)
    for t, w in zip(text, tokens.which, strict=True):
        if learnt[t]:
            kinds[own[t], w] += 1
    contexts = tokens.contexts()
    follow = collections.defaultdict(collections.Counter)
    at = cm.anchors(contexts)
    for a, f in zip(at, tokens.follow(at), strict=True):
        if learnt[text[a]]:
            follow[int(contexts[a])][f.tobytes()] += 1
    rows = sorted((a, *max((n, f) for f, n in c.items()), sum(c.values())) for a, c in follow.items() if sum(c.values()) > 1)
    known = {"context": np.array([r[0] for r in rows], np.uint64), "most": np.array([r[1] for r in rows], np.int64), "times": np.array([r[3] for r in rows], np.int64), "follow": np.frombuffer(b"".join(r[2] for r in rows), np.uint32).reshape(-1, cm.FOLLOW)}
    some = np.nonzero(kinds.sum(axis=0))[0]
    spelled = cm.spell(tokens, np.arange(len(tokens.keys)), cm.Counts(*cm.pair_counts(tokens, some)), cm.start_weights())
    return tokens, kinds, spelled, known


def slow_log(tokens, kinds, spelled, known):
    """text_log, one token at a time."""
    totals, share = kinds.sum(axis=1), kinds.sum(axis=0) / max(kinds.sum(), 1)
    text, _ = tokens.places()
    contexts, check = tokens.contexts(), cm.checks(tokens.keys)
    expects = {int(c): k for k, c in enumerate(known["context"])}
    mine = [(1 - cm.COMMON) * kinds[k] / totals[k] + cm.COMMON * share if totals[k] else share for k in range(cm.KINDS)]
    out = []
    for t in range(len(tokens.count)):
        at = np.nonzero(text == t)[0]
        weights = [w.copy() for w in cm.START]
        steps = [np.zeros_like(w) for w in cm.START]
        had, last, anchor = collections.Counter(), {}, None
        history = [[] for _ in range(4)]
        log, under = 0.0, np.zeros(cm.KINDS)

        def decide(d, yes, first, weights=weights, steps=steps, history=history):
            h = history[d]
            gate = 0 if not h else 2 if h[-1] else 1
            run = next((k for k, y in enumerate(reversed(h)) if not y), len(h))
            x = np.array([1.0, first / 4, math.log((sum(h) + 0.5) / (len(h) - sum(h) + 0.5)), math.log1p(run) / 3])
            p = 1 / (1 + math.exp(-float(weights[d][gate] @ x)))
            steps[d][gate] += cm.RATE * (yes - p) * x
            h.append(yes)
            return math.log(p if yes else 1 - p)

        for i, a in enumerate(at):
            if i and i % cm.SEGMENT == 0:
                for w, s in zip(weights, steps, strict=True):
                    w += s
                    s[:] = 0
            w, context = int(tokens.which[a]), int(contexts[a])
            if context and context % cm.ANCHOR == 0 and context in expects:
                anchor = (i, expects[context])
            denied, done = None, False
            if anchor and i - anchor[0] < cm.FOLLOW and (f := int(known["follow"][anchor[1], i - anchor[0]])):
                most, times = int(known["most"][anchor[1]]), int(known["times"][anchor[1]])
                done = f == int(check[w])
                log += decide(0, done, math.log((most + 0.5) / (times - most + 0.5)))
                denied = f
            if not done and i >= 2 and context in last and int(check[last[context]]) != denied:
                done = last[context] == w
                log += decide(1, done, 0.0)
            if not done and i:
                done = had[w] > 0
                log += decide(2, done, math.log(i + 1))
                if done:
                    log += math.log(had[w] / i)
            if not done:
                in_corpus = bool(share[w])
                log += decide(3, in_corpus, 0.0)
                if in_corpus:
                    under += [math.log(m[w] / max(m[w], 1 - sum(m[v] for v in had))) for m in mine]
                else:
                    log += spelled[w]
            had[w] += 1
            last[context] = w
        out.append(log + math.log(np.exp(under - under.max()).mean()) + under.max())
    return out


def test_scores_token_by_token():
    texts = corpus()
    learnt = np.arange(len(texts)) % 3 > 0
    model = counted(texts, learnt)
    tokens, kinds, spelled, known = model
    assert len(known["context"]) and np.allclose(cm.text_log(tokens, kinds, kinds.sum(axis=1), spelled, known), slow_log(*model), rtol=1e-9)


def test_all_next_tokens_have_a_probability_of_one_at_most():
    texts = corpus()
    tokens, kinds, _, known = counted(texts, np.arange(len(texts)) % 3 > 0)
    start = " ".join(texts[5].split()[:40])
    words = sorted({w.lower() for t in texts for w in t.split()})
    some = cm.Tokens([start.encode(), *[f"{start} {w}".encode() for w in words]])
    place = np.searchsorted(tokens.keys, some.keys)
    assert (tokens.keys[place] == some.keys).all()

    def whole(without_end):
        """The probabilities of the texts without their ends, which stand alone in their own segment of decisions."""
        return cm.text_log(without_end, kinds[:, np.searchsorted(tokens.keys, without_end.keys)], kinds.sum(axis=1), np.full(len(without_end.keys), -50.0), known)

    cut = cm.Tokens([start.encode(), *[f"{start} {w}".encode() for w in words]])
    cut.which = np.delete(cut.which, np.cumsum(cut.count) - 1)
    cut.count = cut.count - 1
    log = whole(cut)
    assert 0.2 < np.exp(log[1:] - log[0]).sum() <= 1 + 1e-9


def test_spelling_is_a_distribution():
    """The probabilities of all next bytes, or the closing space, add up to one after any beginning of a word."""
    tokens = cm.Tokens([b"ab ac abc b ba", b"ab ab"])
    table_ = cm.Counts(*cm.pair_counts(tokens, np.arange(len(tokens.keys))))
    weights = cm.fit_weights(tokens, table_)[0]
    for begin in (b"", b"a", b"ab", b"zzzzzzz"):
        every = cm.Tokens.of(np.arange(256, dtype=np.uint64), [begin + bytes([b]) for b in range(256)])
        every.ends[:] = True  # no closing space is added
        one = cm.Tokens.of(np.zeros(1, np.uint64), [begin or b"\n"])
        one.ends[:] = True
        log = cm.spell(every, np.arange(256), table_, weights)
        assert math.isclose(np.exp(log - (cm.spell(one, np.arange(1), table_, weights)[0] if begin else 0)).sum(), 1, rel_tol=1e-4)


def test_a_longer_strange_token_costs_more(spark):
    rows = [(k, f"some words {k % 7} of a text and more of it") for k in range(60)]
    held = [k for k in range(100, 200) if lm_scoring.MODULUS and __import__("zlib").crc32(str(k).encode()) % 7 == 2][:3]
    rng = random.Random(2)
    rows += [(i, "".join(rng.choice("abcdefghij0123456789+/") for _ in range(n))) for i, n in zip(held, (1_000, 10_000, 100_000), strict=True)]
    found = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b, c = (found[i] for i in held)
    assert c < 5 * b < 25 * a < 0 and b > 20 * a


def test_scores_do_not_depend_on_files_and_beat_the_base(spark, tmp_path):
    docs = table(spark, SF_SMALL, "documents")
    one = {r["doc_id"]: (r["score"], r["base_score"]) for r in lm_scoring.score_texts(docs).collect()}
    docs.repartition(40).write.parquet(str(tmp_path / "many"))
    many = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(spark.read.parquet(str(tmp_path / "many"))).collect()}
    assert all(math.isclose(many[i], s, rel_tol=1e-6) for i, (s, _) in one.items())
    big = lm_scoring.score_texts(table(spark, "/root/testdata/sf0.01", "documents")).filter("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert big[0] > big[1]


def test_every_context_keeps_its_own_counts():
    rng = random.Random(12)
    words = ["zebra", "zeb", *("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(5000))]
    tokens = cm.Tokens([" ".join(words).encode()])
    counts = cm.Counts(*cm.pair_counts(tokens, np.arange(len(tokens.keys))))
    followed = collections.Counter()
    for word in {*words}:
        padded = "\n" * 5 + word + " "
        followed.update((padded[k - 5 : k], padded[k]) for k in range(5, len(padded)))
    followed["\n\n\n\n\n", "\n"] += 1
    for (before, symbol), less in [(k, less) for k in rng.sample(sorted(followed), 200) for less in (0, 1)]:
        context = np.array([3 << 48 | int.from_bytes(before.encode(), "little")], np.uint64)
        found = counts.odds(context, np.array([ord(symbol)], np.uint8), less)[0]
        after = {ord(s): k for s in map(chr, range(256)) if (k := followed[before, s])}
        for bit in range(8):
            same = {s: k for s, k in after.items() if s >> (8 - bit) == ord(symbol) >> (8 - bit)}
            ones = sum(k for s, k in same.items() if s >> (7 - bit) & 1)
            zeros, y = sum(same.values()) - ones, ord(symbol) >> (7 - bit) & 1
            assert found[bit] == np.clip(np.rint(np.log((ones - less * y + 0.4) / (zeros - less * (1 - y) + 0.4)) * cm.SCALE), -127, 127)


def test_every_context_is_counted():
    """What follows is known after each pair of tokens that occurs twice in training texts, whatever the pair's hash and the group's range."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(2)) for _ in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(30)]
    train = [k % 4 > 0 for k in range(30)]
    follows = collections.defaultdict(collections.Counter)
    for text, learnt in zip(texts, train, strict=True):
        tokens = [*text.split(), None]
        for k in range(2, len(tokens) if learnt else 0):
            follows[tokens[k - 2], tokens[k - 1]][tokens[k]] += 1
    sent = [pd.DataFrame({"grp": [k // 10 for k in range(30)], "train": train, "text": texts})]
    counted_ = pd.concat(lm_scoring._context_counts(7)(iter(sent)))
    found = pd.concat([lm_scoring._expected((r,), part) for r, part in counted_.groupby("range")])
    for grp in range(3):
        tokens = cm.Tokens([t.encode() for t in texts[10 * grp : 10 * grp + 10]])
        known = dict(zip(["context", "follow", "most", "times"], lm_scoring._put_together(found["data"][found["grp"] == grp].tolist(), 3), strict=True))
        letters = [tokens.data[s : s + n].tobytes().decode() for s, n in zip(tokens.start, tokens.length, strict=True)]
        check = {int(c): None if w == "\n" else w for c, w in zip(cm.checks(tokens.keys), letters, strict=True)}
        contexts, asked = tokens.contexts(), set()
        for k in np.nonzero(tokens.places()[1] > 1)[0]:
            pair = letters[tokens.which[k - 2]], letters[tokens.which[k - 1]]
            after = follows[pair]
            at = np.searchsorted(known["context"], contexts[k])
            there = at < len(known["context"]) and known["context"][at] == contexts[k]
            assert there == (after.total() > 1)
            if there:
                asked.add(int(contexts[k]))
                most = max(after.values())
                assert (known["most"][at], known["times"][at]) == (most, after.total())
                follow = int(known["follow"][at])
                assert follow not in check or after[check[follow]] == most
        assert asked == set(known["context"].tolist())


def test_packed_counts_are_read_back():
    contexts = np.array([1, 2, 1 << 40, (1 << 64) - 1], np.uint64)
    back = lm_scoring._unpacked(lm_scoring._packed(contexts, np.array([1, 300, 1 << 40, 0]), np.array([9, -8, 7, 6])), 2)
    assert [b.tolist() for b in back] == [contexts.tolist(), [1, 300, 1 << 40, 0], [9, -8, 7, 6]]


def test_contexts_are_counted_apart_when_first_bits_agree():
    """What follows is told apart by all its bits, also where those that share a number with the context are the same."""
    rng = random.Random(6)
    rows = [(rng.choice([5, 6, (1 << cm.CONTEXT_BITS) - 1]), rng.choice([1, 3, 5, 0x80000001, 0x80000003])) for _ in range(500)]
    n = [rng.randint(0, 3) for _ in rows]
    want = collections.Counter()
    for row, k in zip(rows, n, strict=True):
        want[row] += k
    contexts, follow, sums = cm.context_counts(np.array([c for c, _ in rows], np.uint64), np.array([f for _, f in rows], np.uint32), np.array(n))
    assert list(zip(contexts.tolist(), follow.tolist(), sums.tolist(), strict=True)) == [(*row, want[row]) for row in sorted(want)]


def test_tokens_are_summed_over_groups_in_packed_arrays():
    """Each group is answered by the counts in all groups' training texts, in one row of each range, however many tokens there are."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(30)] + ["", "onlyheldout one"]
    train = [k % 4 > 0 for k in range(31)] + [False]
    sent = [pd.DataFrame({"grp": [k // 12 for k in range(32)], "train": train, "text": texts})]
    gathered = pd.concat(lm_scoring._gather(np.eye(cm.KINDS, cm.KIND_WIDTH), 5)(iter(sent)))
    assert len(gathered) <= 3 * 5
    found = pd.concat([lm_scoring._summed((r,), part) for r, part in gathered.groupby("range")])
    learnt = collections.Counter(w for t, y in zip(texts, train, strict=True) if y for w in [*t.split(), None])
    assert found[lm_scoring._COUNTS].to_numpy().sum() == learnt.total() and found["known"].sum() == len(learnt)
    for grp in range(3):
        tokens = cm.Tokens([t.encode() for t in texts[12 * grp : 12 * grp + 12]])
        letters = [tokens.data[s : s + n].tobytes().decode() for s, n in zip(tokens.start, tokens.length, strict=True)]
        want = [learnt[None if w == "\n" else w] for w in letters]
        mine = found[found["grp"] == grp]
        keys, *n = lm_scoring._put_together(mine["data"][mine["what"] == lm_scoring.TOKENS].tolist(), cm.KINDS)
        assert keys.tolist() == tokens.keys.tolist() and sum(n).tolist() == want
        (strange,) = lm_scoring._put_together(mine["data"][mine["what"] == lm_scoring.SPELLED].tolist(), 0)
        assert strange.tolist() == [k for k, c in zip(keys.tolist(), want, strict=True) if not c]
    for _, row in found[found["what"] == lm_scoring.CHUNK].iterrows():
        tokens, known = lm_scoring._chunk_tokens(pd.DataFrame([row]))
        for s, n, y in zip(tokens.start, tokens.length, known, strict=True):
            word = tokens.data[s : s + n].tobytes().decode()
            assert (learnt[None if word == "\n" else word] > 0) == y


def test_spelling_counts_are_summed_over_chunks():
    """Each chunk is sent the counts, over all chunks, of every symbol that follows one of its own contexts of bytes."""
    chunks = [["abc", "abd", "xyz"], ["abe", "q"], ["xya", "abc1"]]
    sent = []
    for k, words in enumerate(chunks):
        tokens = cm.Tokens([" ".join(words).encode()])
        data = lm_scoring._packed_tokens(tokens.keys, tokens.length.astype(np.uint32), tokens.letters(), np.ones((1, len(tokens.keys)), np.uint32))
        sent += lm_scoring._contexts(4)(iter([pd.DataFrame({"chunk": [k], "data": [data]})]))
    sums = pd.concat([lm_scoring._context_sums((r,), part) for r, part in pd.concat(sent).groupby("range")])
    every = [cm.pair_counts(t := cm.Tokens([" ".join(words).encode()]), np.arange(len(t.keys))) for words in chunks]
    total = collections.Counter()
    for pairs, n in every:
        total.update(dict(zip(pairs.tolist(), n.tolist(), strict=True)))
    for k, (pairs, _) in enumerate(every):
        own = {p >> 8 for p in pairs.tolist()}
        found = lm_scoring._put_together(sums["data"][sums["chunk"] == k].tolist(), 1)
        assert dict(zip(*(a.tolist() for a in found), strict=True)) == {p: n for p, n in total.items() if p >> 8 in own}


def test_packed_numbers_take_the_bytes_that_they_need():
    keys = np.arange(1000, dtype=np.uint64) * np.uint64(200)
    assert len(lm_scoring._packed(keys, np.ones(1000, np.int64), np.full(1000, 1 << 20))) < 1000 * 5 + 10


def test_a_rare_kind_has_its_own_centre(spark):
    """Five texts among 3,000 are of other words: no 512 smallest hashes need to hold one of them, but all texts are drawn from."""
    rng = random.Random(9)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(60)),) for _ in range(3000)]
    rare = [" ".join(f"{w}{w}" for w in rng.choices("uvwxyz", k=60)) for _ in range(5)]
    centres = lm_scoring.fit_kinds(spark.createDataFrame(rows + [(t,) for t in rare], "text string"))
    vectors = cm.kind_vectors(cm.Tokens([t.encode() for t in [*rare, *(r[0] for r in rows[:200])]]))
    own = np.argmax(vectors @ centres.T, axis=1)
    assert len({*own[:5]}) == 1 and own[0] not in own[5:]


def test_python_is_handed_few_bytes_at_once(spark):
    """Rows of 20 KB, fewer than a batch may hold: of a table, of a group and of two groups, all are read, a few megabytes at a time."""
    rows = spark.range(600).selectExpr("id % 2 AS grp", "repeat('x', 20000) AS text").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"most": [b["text"].str.len().sum()]})

    def group_sizes(key, left, right):
        import pyarrow as pa

        return pa.table({"most": [b["text"].nbytes for b in left.to_batches()]})

    for found in (rows.mapInPandas(sizes, "most long"), rows.groupBy("grp").cogroup(rows.groupBy("grp")).applyInArrow(group_sizes, "most long")):
        most = [r["most"] for r in lm_scoring._stored(found, "test-batches").collect()]
        assert 600 * 20_000 <= sum(most) <= 600 * 20_100 and max(most) < 3_000_000


def test_a_group_is_scored_where_arrow_holds_it():
    """Counts that come in rows of several batches, and texts whose bytes Arrow holds, give the scores of text_log."""
    import pyarrow as pa

    texts = corpus(5)
    tokens, kinds, spelled, known = counted(texts, np.arange(len(texts)) % 3 > 0)
    strange = np.nonzero(kinds.sum(axis=0) == 0)[0]
    rows = [(lm_scoring.TOKENS, lm_scoring._packed(tokens.keys[part], *kinds[:, part])) for part in np.array_split(np.arange(len(tokens.keys)), 3)]
    rows.append((lm_scoring.SPELLED, lm_scoring._packed(tokens.keys[strange], spelled[strange].view(np.int64))))
    rows += [(lm_scoring.EXPECTED, lm_scoring._packed(known["context"][part], known["follow"][part, 0].astype(np.int64), known["most"][part], known["times"][part])) for part in np.array_split(np.arange(len(known["context"])), 2)]
    sent = pa.concat_tables(pa.table({"what": pa.array([what], pa.int32()), "data": pa.array([data], pa.binary())}) for what, data in rows)
    docs = pa.concat_tables(pa.table({"doc_id": pa.array(range(a, b)), "train": [True] * (b - a), "text": texts[a:b]}) for a, b in ((0, 10), (10, len(texts))))
    found = lm_scoring._score(kinds.sum(axis=1), pa.int64())((0,), docs, sent)
    expected = cm.text_log(tokens, kinds, kinds.sum(axis=1), spelled, known) / math.log(10)
    assert np.allclose(found["score"].to_numpy(), expected, rtol=1e-9) and found["doc_id"].to_pylist() == list(range(len(texts)))
    assert found["bytes"].to_pylist() == [len(t.encode()) for t in texts]

"""Windows over blocks against a walk through them, on random blocks."""

import random

from pyspark.sql import functions as F

from lectern.operators import chunker, topics


def deeper(old, new):
    a, b = [[int(x) for x in n.split(".")] for n in (old, new)]
    return len(b) > len(a) and b[: len(a)] == a


def walk(blocks):
    """Chunks as (title, number, path, kind, positions), one block after the other."""
    out, held, anchor, title, titles = [], [], None, "", {}

    def close(kind="", own=""):
        nonlocal held
        if held:
            name = own or title or held[0]["title"]
            number = anchor or ""
            path = name
            if number:
                keys = [".".join(number.split(".")[: n + 1]) for n in range(number.count(".") + 1)]
                path = " > ".join(f"{k} {titles[k]}" for k in keys if k in titles)
            out.append((name, number, path, kind, tuple(b["pos"] for b in held)))
        held = []

    for b in blocks:
        t = b["block_type"]
        if t == "toc_entry":
            continue
        if t == "toc":
            close()
            anchor, title = None, ""
            held = [b]
            close("toc", "目录")
        elif t == "front_matter":
            close()
            held = [b]
            close("meta", b["title"])
            anchor, title = None, ""
        elif t in ("warning", "page_header"):
            held.append(b)
        elif t == "numbered":
            n = b["section_number"]
            if anchor and not deeper(anchor, n):
                close()
            titles[n] = b["clean_title"]
            for k in list(titles):
                if k != n and not n.startswith(k + ".") and not k.startswith(n + ".") and k.count(".") >= n.count("."):
                    del titles[k]
            anchor, title = n, f"{n} {b['clean_title']}"
            held.append(b)
        elif len(b["content"]) >= 60 and held:
            close()
            held, title, anchor = [b], b["title"], None
        elif held:
            held.append(b)
        else:
            held, title = [b], b["title"]
    close()
    return out


def random_blocks(rng, doc):
    rows = []
    for pos in range(rng.randint(1, 14)):
        kind = rng.choice(["numbered"] * 6 + ["plain"] * 3 + ["warning", "page_header", "toc", "toc_entry", "front_matter"])
        number = ".".join(str(rng.randint(1, 2)) for _ in range(rng.randint(1, 3))) if kind == "numbered" else ""
        title = f"t{pos}" if kind != "toc" else "目录"
        body = "x" * (70 if rng.random() < 0.4 else 5)
        rows.append({"doc_id": doc, "pos": pos, "title": title, "content": f"# {title}\n{body}", "block_type": kind, "section_number": number, "clean_title": title if number else ""})
    return rows


def test_merge_blocks_like_a_walk(spark):
    rng = random.Random(5)
    docs = {d: random_blocks(rng, d) for d in range(400)}
    df = spark.createDataFrame([tuple(r.values()) for rows in docs.values() for r in rows], "doc_id long, pos long, title string, content string, block_type string, section_number string, clean_title string")
    found = {}
    for r in chunker.merge_blocks(df).orderBy("doc_id", "chunk_pos").collect():
        found.setdefault(r["doc_id"], []).append((r["section_title"], r["section_number"], r["section_path"], r["block_types"]))
    for d, rows in docs.items():
        kinds = {r["pos"]: r["block_type"] for r in rows}
        expected = [(n, num, path, [kinds[p] for p in at]) for n, num, path, _, at in walk(rows)]
        assert found.get(d, []) == expected, d


def test_identities_of_stored_chunks(spark):
    from lectern.functions import text as T

    row = spark.range(1).select(T.doc_id(F.lit("手册")).alias("d"), T.chunk_id(F.lit("doc-1"), F.lit(3), F.lit("内容")).alias("c"), T.content_hash(F.lit(None).cast("string")).alias("h")).first()
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert row == ("doc-" + md5("手册"), "chunk-" + md5("doc-1|3|内容"), md5(""))


def test_oversize_titles_and_order(spark):
    text = "# 长节\n" + "\n\n".join(["字" * 300] * 5)
    rows = chunker.split_semantic(spark.createDataFrame([(1, text)], "doc_id long, text string"), max_tokens=650).orderBy("order_index").collect()
    assert [r["section_title"] for r in rows] == ["长节 (1/3)", "长节 (2/3)", "长节 (3/3)"]
    assert [r["order_index"] for r in rows] == [0, 1, 2]


def test_every_trigger_fires(spark):
    from lectern import vocab

    asked = [(k, p.split("|")[0], None) for k, p in enumerate(vocab.TOPIC_TRIGGERS.values())]
    rows = topics.triggered(spark.createDataFrame(asked, "query_id long, text string, product_id string")).collect()
    assert {(r["query_id"], r["bucket"]) for r in rows} >= set(enumerate(vocab.TOPIC_TRIGGERS))

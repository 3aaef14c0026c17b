"""Ingest, search, streams and sources end to end, on small collections."""

import io
import json
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern import api, fixtures, providers, schema, vocab
from lectern.operators import ranking, sync
from lectern.plans.ingest import ingest
from lectern.plans.search import Engine
from lectern.sources import docx, images, manuals, products, tables
from lectern.streaming import answers
from lectern.streaming.ingest import merge_batch, start_ingest

LONG = "登录平台时请输入账号和密码，忘记密码时点击找回，并按提示完成验证码校验之后重新设置。" * 3


@pytest.fixture()
def setup(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "src").mkdir()
    for stem, body in (("手册甲", f"# 账号登录\n{LONG}\n![x](images/a.png)\n# 报表导出\n{'导出报表时选择时间范围再下载文件。' * 6}"), ("手册乙", f"# 设备管理\n{'添加设备前先扫描序列号并绑定电站。' * 6}")):
        (tmp_path / "md" / f"{stem}.md").write_text(body, encoding="utf-8")
    for name in ("甲.pdf", "乙.pdf"):
        (tmp_path / "src" / name).write_bytes(name.encode())
    tree = {"series": [{"id": "s1", "name": "户用", "products": [{"id": p, "display_name": n, "manual_pdf": f, "md_stem": m, "aliases": a} for p, n, f, m, a in (("p1", "甲系统", "甲.pdf", "手册甲", ["甲号"]), ("p2", "乙系统", "乙.pdf", "手册乙", []))]}]}
    (tmp_path / "products.json").write_text(json.dumps(tree), encoding="utf-8")
    return tmp_path, products.read_products(spark, str(tmp_path / "products.json")), tables.Collection(spark, str(tmp_path / "kb"))


def run(spark, folder, known, kb, **more):
    return ingest(kb, known, manuals.read_markdown(spark, str(folder / "md")), manuals.hashed_files(spark, str(folder / "src"), known), now=1, min_tokens=10, **more)


def test_ingest_then_changes_only(spark, setup):
    folder, known, kb = setup
    assert {r["status"] for r in run(spark, folder, known, kb).collect()} == {"new"}
    first = {r["chunk_id"]: r for r in kb.read("chunks", schema.CHUNKS).collect()}
    assert len(first) == 3 and kb.status() == {"vectors_ready": True, "terms_ready": True, "chunk_count": 3}
    assert {r["status"] for r in run(spark, folder, known, kb, only_changes=True).collect()} == {"unchanged"}
    (folder / "src" / "乙.pdf").write_bytes(b"changed")
    (folder / "md" / "手册乙.md").write_text(f"# 设备管理\n{'新的说明文字，用于检查更新之后的内容。' * 6}", encoding="utf-8")
    changes = {r["product_id"]: r["status"] for r in run(spark, folder, known, kb, only_changes=True).collect()}
    assert changes == {"p1": "unchanged", "p2": "changed"}
    second = {r["chunk_id"]: r for r in kb.read("chunks", schema.CHUNKS).collect()}
    full = tables.Collection(spark, str(folder / "kb2"))
    run(spark, folder, known, full)
    assert second == {r["chunk_id"]: r for r in full.read("chunks", schema.CHUNKS).collect()} and set(second) != set(first)
    assert {r["chunk_id"] for r in kb.read("vectors", schema.VECTORS).collect()} == set(second)
    for name in ("甲.pdf", "乙.pdf"):
        (folder / "src" / name).unlink()
    with pytest.raises(ValueError, match="all products"):
        run(spark, folder, known, kb, only_changes=True)
    run(spark, folder, known, kb, only_changes=True, force=True)
    assert kb.read("chunks", schema.CHUNKS).count() == 0 and tables.read_manifest(kb).count() == 0


def engine(spark, setup, reranker=None):
    folder, known, kb = setup
    run(spark, folder, known, kb)
    return Engine.build(kb.read("chunks", schema.CHUNKS), vectors=kb.read("vectors", schema.VECTORS), products=known, sections=spark.read.parquet(f"{kb.root}/sections/{kb.version('sections')}"), embedder=providers.HashedEmbedder, reranker=reranker)


QUESTIONS = [(1, "忘记密码怎么登录", None, ""), (2, "如何导出报表", "p1", "User: 你好"), (3, "  ", None, ""), (4, "添加设备", "p1", None)]


def test_retrieve_and_answer(spark, setup):
    e = engine(spark, setup, providers.OverlapReranker)
    asked = spark.createDataFrame(QUESTIONS, "query_id long, text string, product_id string, history string")
    hits = e.retrieve(asked).collect()
    best = {r["query_id"]: r["section_title"] for r in hits if r["rank"] == 1}
    assert best[2] == "报表导出" and all(0 <= r["score"] <= 1 for r in hits)
    assert all(r["product_id"] == "p1" for r in hits if r["query_id"] in (2, 4))
    ready = e.prepare(asked, "平台使用指南")
    states = {r["query_id"]: r for r in ready.collect()}
    assert states[3]["state"] == "blank" and states[2]["state"] == "ready" and "对话历史" in states[2]["prompt"] and "当前选定文档：甲系统" in states[2]["prompt"]
    events = list(answers.answer_events(ready.filter("query_id = 2"), providers.ExtractiveChat(), "", "没有找到"))
    assert events[0].startswith("event: meta\n") and events[-1].startswith("event: done\n") and any("delta" in x for x in events)
    assert e.trace(asked, 2).count() == e.retrieve(asked, 2).count()
    plain = e.search(asked.filter("query_id <> 3"), 2)
    assert plain.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 2


def test_service(spark, setup):
    folder, known, kb = setup
    (folder / "md" / "images").mkdir()
    (folder / "md" / "images" / "a.png").write_bytes(b"png")
    built = engine(spark, setup)
    kb.write("images", images.referenced_images(built.chunks, str(folder / "md" / "images")))
    service = api.Service(spark, kb, lambda: built, providers.ExtractiveChat(), "使用指南", token="t", reindex=lambda: run(spark, folder, known, kb, only_changes=True))

    def call(method, path, body=None, query="token=t"):
        raw, said = json.dumps(body).encode() if body is not None else b"", []
        out = b"".join(service.application({"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_LENGTH": str(len(raw)), "wsgi.input": io.BytesIO(raw)}, lambda s, h: said.append(s)))
        return said[0][:3], out

    assert call("GET", "/api/v1/products", query="")[0] == "401"
    assert len(json.loads(call("GET", "/api/v1/products")[1])) == 2
    assert json.loads(call("GET", "/api/v1/kb/status")[1])["chunk_count"] == 3
    assert json.loads(call("POST", "/api/v1/search", {"query": "导出报表", "top_k": 1})[1])[0]["title"] == "报表导出"
    answer = json.loads(call("POST", "/api/v1/chat", {"question": "忘记密码怎么登录", "product_id": "p1", "history": [{"role": "user", "content": "你好"}]})[1])
    assert answer["sources"] and answer["images"][0]["image_id"] == "图-1" and answer["images"][0]["display_url"].startswith("/kb_images/doc-")
    assert call("GET", answer["images"][0]["display_url"]) == ("200", b"png")
    assert json.loads(call("POST", "/api/v1/chat", {"question": " "})[1])["answer"] == vocab.BLANK_QUESTION
    assert b"event: done" in call("POST", "/api/v1/chat/stream", {"question": "添加设备"})[1]
    assert json.loads(call("POST", "/api/v1/admin/reindex", {})[1]) == {"ok": True, "products": {"unchanged": 2}}
    assert call("GET", "/nowhere")[0] == "404"
    assert tables.collection_root(spark, f"{kb.root}/chunks") == kb.root


def test_reranker_that_fails_keeps_scores(spark):
    def broken():
        raise RuntimeError("no model")

    hits = spark.createDataFrame([(1, "q", k, "t", "c", 1.0 / (k + 1)) for k in range(5)], "query_id long, query_text string, chunk_id long, section_title string, content string, score double")
    assert [r["chunk_id"] for r in ranking.rerank(hits, broken, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_stream_equals_batch(spark, setup):
    folder, known, kb = setup
    streamed = tables.Collection(spark, str(folder / "kb3"))
    start_ingest(spark, str(folder / "md"), streamed, known, str(folder / "cp"), now=1, once=True).awaitTermination()
    (folder / "md" / "手册乙2.md").write_text("# x\n短", encoding="utf-8")
    start_ingest(spark, str(folder / "md"), streamed, known, str(folder / "cp"), now=1, once=True).awaitTermination()
    titles = {r["section_title"] for r in streamed.read("chunks", schema.CHUNKS).collect()}
    assert titles == {"账号登录", "报表导出", "设备管理"}
    assert not streamed.exists("vectors") and streamed.exists("sections")


def test_stream_drops_chunks_of_emptied_documents(spark, setup):
    folder, known, kb = setup
    streamed = tables.Collection(spark, str(folder / "kb4"))
    start = lambda: start_ingest(spark, str(folder / "md"), streamed, known, str(folder / "cp4"), now=1, once=True, embedder=providers.HashedEmbedder).awaitTermination()
    start()
    ids = {r["chunk_id"] for r in streamed.read("chunks", schema.CHUNKS).collect()}
    assert {r["chunk_id"] for r in streamed.read("vectors", schema.VECTORS).collect()} == ids and len(ids) == 3
    (folder / "md" / "手册乙.md").write_text("# 设备管理\n短", encoding="utf-8")
    batch = manuals.read_markdown(spark, str(folder / "md")).filter("md_stem = '手册乙'")
    merge_batch(streamed, known, 1, providers.HashedEmbedder)(batch, 1)
    left = {r["chunk_id"] for r in streamed.read("chunks", schema.CHUNKS).collect()}
    assert left < ids and len(left) == 2
    assert {r["chunk_id"] for r in streamed.read("vectors", schema.VECTORS).collect()} == left


def test_pointer_moves_in_one_step(spark, tmp_path):
    kb = tables.Collection(spark, str(tmp_path / "kb"))
    for k in range(3):
        kb.write("tombstones", spark.createDataFrame([(str(k),)], schema.TOMBSTONES))
    assert [r["chunk_id"] for r in kb.read("tombstones", schema.TOMBSTONES).collect()] == ["2"]
    assert not list((tmp_path / "kb" / "tombstones").glob("staged-*"))


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(k, "old") for k in range(6)], "chunk_id long, content string")
    new, gone = spark.createDataFrame([(2, "new"), (9, "new")], base.schema), spark.createDataFrame([(3,)], "chunk_id long")
    once = sync.upsert(base, new, gone)
    assert sorted(map(tuple, sync.upsert(once, new, gone).collect())) == sorted(map(tuple, once.collect()))
    assert {r["chunk_id"]: r["content"] for r in once.collect()} == {0: "old", 1: "old", 2: "new", 4: "old", 5: "old", 9: "new"}


def word_file() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    p = lambda text, style="", extra="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t>{extra}</w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("总览", "H1") + p("正文  文字") + p("3.1登录") + f"<w:tbl><w:tr>{cell('名')}{cell('值')}</w:tr><w:tr>{cell('甲')}</w:tr></w:tbl>" + p("图", "", '<a:blip r:embed="r1"/>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="media/i.png"/></Relationships>')
        z.writestr("word/media/i.png", b"PNG")
    return out.getvalue()


def test_word_documents(spark, tmp_path):
    Path(tmp_path, "文档.docx").write_bytes(word_file())
    Path(tmp_path, "坏.docx").write_bytes(b"no zip")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = {r["md_stem"]: r for r in manuals.parse_documents(files, spark.createDataFrame([], "md_stem string"), docx.DocxParser).collect()}
    assert rows["坏"]["error"] and rows["文档"]["error"] is None
    text = rows["文档"]["text"]
    assert text.startswith("# 总览\n\n正文 文字\n\n# 3.1登录\n\n| 名 | 值 |\n| --- | --- |\n| 甲 |  |\n") and "![" in text
    done = spark.createDataFrame([("文档",), ("坏",)], "md_stem string")
    assert manuals.parse_documents(files, done, docx.DocxParser).count() == 0


def test_image_sizes_and_parts(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    jpg = b"\xff\xd8\xff\xe0\x00\x04xx\xff\xc0\x00\x11\x08" + (77).to_bytes(2, "big") + (99).to_bytes(2, "big") + b"\0" * 8
    files = spark.createDataFrame([(1, 0, "a.png", png), (1, 1, "b.jpg", jpg), (1, 2, "c.gif", b"GIF"), (1, 3, "a.png", png), (1, 4, "d.png", png)], "query_id long, pos int, path string, content binary")
    found = {r["path"]: (r["width"], r["height"]) for r in images.with_sizes(files).collect()}
    assert found["a.png"] == (640, 480) and found["b.jpg"] == (99, 77) and found["c.gif"] == (None, None)
    parts = images.inline_parts(files).first()["parts"]
    assert [p["mimeType"] for p in parts] == ["image/png", "image/jpeg", "image/gif"]


def test_chunk_maps(spark, tmp_path):
    Path(tmp_path, "kv.json").write_text(json.dumps({"c1": {"tokens": 3, "content": "x", "image_paths": ["a"]}}), encoding="utf-8")
    row = tables.read_chunk_map(spark, str(tmp_path / "kv.json")).first()
    assert (row["chunk_id"], row["tokens"], row["image_paths"]) == ("c1", 3, ["a"])
    Path(tmp_path, "list.json").write_text("[1]", encoding="utf-8")
    with pytest.raises(Exception, match="one object"):
        tables.read_chunk_map(spark, str(tmp_path / "list.json")).collect()
    flat = tables.metadata(tables.read_chunk_map(spark, str(tmp_path / "kv.json"))).first()
    assert flat["image_paths"] == "a" and "content" not in flat.asDict()
    chunks = tables.read_chunk_map(spark, str(tmp_path / "kv.json"))
    tables.write_chunk_map(chunks, str(tmp_path / "lines"))
    assert tables.read_chunk_lines(spark, str(tmp_path / "lines")).collect() == chunks.collect()


def test_providers(spark):
    calls = []

    def sometimes():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429 too many")
        return "ok"

    waits = []
    assert providers.with_retries(sometimes, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(KeyError):
        providers.with_retries(lambda: {}["x"], sleep=waits.append)
    cached = providers.CachedEmbedder(providers.HashedEmbedder(8), size=1)
    assert cached.embed_query("一二") == cached.embed_query("一二")
    rows = spark.createDataFrame([(1, "甲乙"), (2, "甲乙"), (3, None)], "k long, t string")
    got = {r["k"]: r["embedding"] for r in providers.embed(rows, "k", "t", providers.HashedEmbedder).collect()}
    assert got[1] == got[2] and len(got[3]) == 256

    class Picky:
        def stream(self, system, prompt, images=None):
            if images:
                raise RuntimeError("no images")
            yield "text"

    assert providers.chat_once(Picky(), "", "", [{}]) == "text"


def test_empty_fixture_tables(spark):
    nothing = spark.sql(fixtures.RANKED).limit(0)
    assert ranking.post_rank(nothing).count() == 0 and ranking.score_gap(nothing, 3).count() == 0

"""The engine's requests, and a WSGI application for them.

Handlers take plain values and return plain values; `application()` puts them behind addresses, with the standard library only:
products, chat, chat/stream (server-sent events), search, kb/status, admin/reindex, and stored images below /kb_images/.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import parse_qs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schema, vocab
from lectern.functions import urls
from lectern.operators import context
from lectern.plans.search import Engine
from lectern.providers import ChatModel, chat_once
from lectern.sources.tables import Collection
from lectern.streaming.answers import answer_events, write_event

class Denied(Exception):
    """A request without the configured token."""


class Service:
    """Requests on one collection; without a configured token every request is let through."""

    def __init__(self, spark: SparkSession, collection: Collection, engine: Callable[[], Engine], chat: ChatModel, subject: str, system: str = "", token: str = "", public_base: str = "", reindex: Callable[[], DataFrame] | None = None):
        self.spark, self.collection, self._build, self.chat, self.subject = spark, collection, engine, chat, subject
        self.system, self.token, self.base, self._reindex = system, token, public_base, reindex
        self._engine: Engine | None = None

    def verify(self, token: str) -> None:
        if self.token and token != self.token:
            raise Denied

    def engine(self, force: bool = False) -> Engine:
        """Built when first needed, and again after a change."""
        if self._engine is None or force:
            self.collection.reset()
            self._engine = self._build()
        return self._engine

    def _asked(self, question: str, product_id: str | None, history: list[dict[str, str]]) -> DataFrame:
        turns = [(1, k, h.get("role", ""), str(h.get("content") or "")) for k, h in enumerate(history)]
        past = context.history(self.spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
        asked = self.spark.createDataFrame([(1, question, product_id)], "query_id long, text string, product_id string")
        return asked.join(past.withColumnRenamed("conv_id", "query_id"), "query_id", "left")

    def products(self) -> list[dict[str, Any]]:
        known = self.engine().products
        return [r.asDict() for r in known.toLocalIterator()] if known is not None else []

    def answer(self, question: str, product_id: str | None = None, history: list[dict[str, str]] = ()) -> dict[str, Any]:
        row = self.engine().prepare(self._asked(question, product_id, list(history)), self.subject).first()
        images = [i.asDict() for i in row["images"] or []]
        if row["state"] != "ready":
            return {"answer": vocab.BLANK_QUESTION if row["state"] == "blank" else vocab.NO_RESULT.format(subject=self.subject), "sources": [], "images": []}
        said = chat_once(self.chat, self.system, row["prompt"])
        known = F.lit(None).cast("array<struct<image_id:string,display_url:string,caption_hint:string>>") if not images else F.array(*[F.struct(*[F.lit(i[k]).alias(k) for k in ("image_id", "display_url", "caption_hint")]) for i in images])
        known = F.coalesce(known, F.array().cast("array<struct<image_id:string,display_url:string,caption_hint:string>>"))
        shown = self.spark.range(1).select(urls.public_answer(F.lit(said), known, self.base).alias("a"), urls.public_images(known, self.base).alias("i")).first()
        return {"answer": shown["a"], "sources": [s.asDict() for s in row["sources"] or []], "images": [i.asDict() for i in shown["i"]]}

    def answer_stream(self, question: str, product_id: str | None = None, history: list[dict[str, str]] = ()) -> Iterator[str]:
        try:
            ready = self.engine().prepare(self._asked(question, product_id, list(history)), self.subject)
            yield from answer_events(ready, self.chat, self.system, vocab.NO_RESULT.format(subject=self.subject), vocab.BLANK_QUESTION)
        except Exception as e:  # told to the client, which is reading already
            yield write_event("error", {"message": str(e)})

    def search(self, query: str, top_k: int = 5, product_id: str | None = None) -> list[dict[str, Any]]:
        """At most 20 results; a failing search has none."""
        try:
            asked = self.spark.createDataFrame([(1, query, product_id)], "query_id long, text string, product_id string")
            hits = self.engine().search(asked, min(20, max(1, top_k)))
            for c in ("source", "title"):
                if c not in hits.columns:
                    hits = hits.withColumn(c, F.lit(None).cast("string"))
            return [r.asDict() for r in context.search_response(hits).orderBy("rank").collect()]
        except Exception:
            return []

    def status(self) -> dict[str, object]:
        return self.collection.status()

    def reindex(self) -> dict[str, Any]:
        if self._reindex is None:
            raise LookupError("no way to reindex is configured")
        done = {r["status"]: r["count"] for r in self._reindex().groupBy("status").count().collect()}
        self.engine(force=True)
        return {"ok": True, "products": done}

    def application(self, environ: dict[str, Any], start: Callable) -> Iterator[bytes]:
        """WSGI: JSON in and out, a token as the parameter or field `token`."""
        size = int(environ.get("CONTENT_LENGTH") or 0)
        path, method = environ.get("PATH_INFO", "/").rstrip("/"), environ.get("REQUEST_METHOD", "GET")
        kind, status = "application/json; charset=utf-8", "200 OK"
        body: Any
        try:
            given = json.loads(environ["wsgi.input"].read(size) or b"{}") if size else {}
            given |= {k: v[0] for k, v in parse_qs(environ.get("QUERY_STRING", "")).items()}
            self.verify(str(given.get("token", "")))
            asked = (str(given.get("question", "")), given.get("product_id") or None, given.get("history") or [])
            match (method, path):
                case ("GET", "/api/v1/products"):
                    body = self.products()
                case ("POST", "/api/v1/chat"):
                    body = self.answer(*asked)
                case ("POST", "/api/v1/chat/stream"):
                    start(status, [("Content-Type", "text/event-stream; charset=utf-8")])
                    return (part.encode() for part in self.answer_stream(*asked))
                case ("POST", "/api/v1/search"):
                    body = self.search(str(given.get("query", "")), int(given.get("top_k", 5)), given.get("product_id") or None)
                case ("GET", "/api/v1/kb/status"):
                    body = self.status()
                case ("POST", "/api/v1/admin/reindex"):
                    body = self.reindex()
                case ("GET", p) if p.startswith(urls.ROOT):
                    row = self.collection.read("images", schema.IMAGES).filter(F.col("rel_path") == p.removeprefix(urls.ROOT)).first()
                    if row is not None:
                        start(status, [("Content-Type", "application/octet-stream")])
                        return iter([bytes(row["content"])])
                    status, body = "404 Not Found", {"error": "no such image"}
                case _:
                    status, body = "404 Not Found", {"error": "no such address"}
        except Denied:
            status, body = "401 Unauthorized", {"error": "wrong token"}
        except Exception as e:  # a request must not end the server
            status, body = "500 Internal Server Error", {"error": str(e)[-2000:]}
        start(status, [("Content-Type", kind)])
        return iter([json.dumps(body, ensure_ascii=False, default=str).encode()])


def system_prompt(subject: str) -> str:
    """What an answering model is asked to keep to."""
    return (
        f"你是{subject}的技术顾问。仅根据检索片段和随附图片回答，禁止编造；片段不足时明确说明未找到相关信息。"
        f"用标准 Markdown 段落与列表作答，界面名称加粗；引用处在句末标注 *(章节: xxx)*；提到配图时插入原样编号 [图-N]，不写 URL。"
        f"最多引用 {vocab.MAX_IMAGES} 张图片，输出纯中文。"
    )

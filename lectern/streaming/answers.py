"""Answers as they come: events for a client, and frames put together from the pieces of a raw stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions.frames import frames
from lectern.providers import ChatModel, chat_stream


def write_event(name: str, payload: Any) -> str:
    return f"event: {name}\ndata: {json.dumps(payload, ensure_ascii=False)}\n\n"


def answer_events(prepared: DataFrame, model: ChatModel, system: str, no_result: str, blank: str = vocab.BLANK_QUESTION) -> Iterator[str]:
    """For each prepared question: an event with sources and images, the answer in pieces, and an end."""
    for row in prepared.toLocalIterator():
        meta = {"query_id": row["query_id"], "sources": [s.asDict() for s in row["sources"] or []], "images": [i.asDict() for i in row["images"] or []]}
        yield write_event("meta", meta)
        if row["state"] == "ready":
            for part in chat_stream(model, system, row["prompt"]):
                yield write_event("delta", {"text": part})
        else:
            yield write_event("delta", {"text": blank if row["state"] == "blank" else no_result})
        yield write_event("done", {"query_id": row["query_id"]})


def assembled(pieces: DataFrame) -> DataFrame:
    """pieces (request_id, seq, raw) to each request's events and unfinished rest."""
    whole = pieces.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "raw"))), lambda x: x["raw"]), "").alias("raw"))
    return whole.select("request_id", frames(F.col("raw")).alias("f")).select("request_id", "f.events", "f.rest")


def assembled_text(deltas: DataFrame) -> DataFrame:
    """deltas (request_id, seq, text) to each request's answer."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
    return deltas.groupBy("request_id").agg(F.array_join(ordered, "").alias("answer"))

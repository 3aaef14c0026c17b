"""Messages on event streams: parsing, decoding and writing frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import text


def frames(raw: Column) -> Column:
    """Struct (events: array of struct(event, data), rest): complete frames of a raw stream, and what is left after the last blank line."""
    parts = F.split(text(raw), "\n\n", -1)
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def parse(p: Column) -> Column:
        lines = F.split(p, "\n")
        named = F.filter(lines, lambda x: F.startswith(x, F.lit("event:")))
        data = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("data:"))), lambda x: F.trim(F.substr(x, F.lit(6))))
        name = F.coalesce(F.trim(F.substr(F.element_at(named, -1), F.lit(7))), F.lit("message"))
        return F.struct(F.when(F.size(named) > 0, name).otherwise("message").alias("event"), F.array_join(data, "").alias("data"))

    events = F.filter(F.transform(whole, parse), lambda e: (e["data"] != "") & F.try_parse_json(e["data"]).isNotNull())
    return F.struct(events.alias("events"), F.element_at(parts, -1).alias("rest"))


def payload_text(line: Column) -> Column:
    """The text of one line of a model's stream: an object, or a list of objects, with candidates; empty for anything else."""
    bare = F.trim(F.regexp_replace(F.trim(text(line)), "^data:", ""))
    kind = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>>"
    listed = F.when(F.startswith(bare, F.lit("[")), bare).otherwise(F.concat(F.lit("["), bare, F.lit("]")))
    items = F.from_json(listed, f"array<{kind}>")
    first = lambda o: F.get(o["candidates"], F.lit(0))["content"]["parts"]
    said = F.transform(F.coalesce(items, F.array().cast(f"array<{kind}>")), lambda o: F.array_join(F.transform(F.coalesce(first(o), F.array().cast("array<struct<text:string>>")), lambda p: text(p["text"])), ""))
    return F.when(bare.isin("", "[DONE]"), "").otherwise(F.array_join(said, ""))


def event_frame(name: Column, payload: Column) -> Column:
    """An event with a JSON payload, as written to a client."""
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def history_line(role: Column, said: Column) -> Column:
    """A line of the conversation; null for other roles."""
    return F.when(role == "user", F.concat(F.lit("User: "), text(said))).when(role == "assistant", F.concat(F.lit("AI: "), text(said)))

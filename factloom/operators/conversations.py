"""Conversations as rows: flattened texts, titles, shown messages, tool calls, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lengths of titles and details, threads listed, states scanned for that.
TITLE, TITLE_KEY, DETAIL, LISTED, SCANNED = 48, 6, 180, 12, 300
# End of fixed values.

CALLS = "array<struct<name:string,args:string>>"


def flatten_parts(parts: Column) -> Column:
    """The texts of a message's parts (struct type, text), a line each; blank ones are left out."""
    return F.array_join(F.filter(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), lambda x: x != ""), "\n")


def shown(messages: DataFrame, role: str = "role") -> DataFrame:
    """Messages without those of tools; blank ones stay."""
    return messages.where(~F.col(role).eqNullSafe("tool"))


def titles(messages: DataFrame, key: str, order: str, most: int = TITLE) -> DataFrame:
    """(key, title): the start of the first user message, else ``Thread`` and the start of the key."""
    first = F.min_by("text", F.when((F.col("role") == "user") & F.col("text").isNotNull(), F.col(order)))
    other = F.concat(F.lit("Thread "), F.substring(F.col(key).cast("string"), 1, TITLE_KEY))
    return messages.groupBy(key).agg(F.coalesce(F.nullif(F.substring(first, 1, most), F.lit("")), other).alias("title"))


def chat_rows(states: DataFrame) -> DataFrame:
    """(thread_id, place, part, role, content) of stored messages (thread_id, place, type, text, name, calls).

    Human messages are the user's; an AI message gives a row for each tool call and then its text, if that isn't
    blank; a tool message gives its result.  Other types give nothing.
    """
    call = F.transform(F.coalesce("calls", F.array().cast(CALLS)), lambda c: F.struct(F.lit("tool").alias("role"), F.concat(F.lit("[tool call: "), F.coalesce(c["name"], F.lit("unknown")), F.lit(", query:"), F.coalesce(c["args"], F.lit("{}")), F.lit("]")).alias("content")))
    one = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    text = F.coalesce("text", F.lit(""))
    said = F.when(F.trim(text) != "", one("agent", text)).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    result = one("tool", F.concat(F.lit("[tool result: "), F.coalesce("name", F.lit("tool_result")), F.lit("] "), text))
    rows = F.when(F.col("type") == "human", one("user", text)).when(F.col("type") == "ai", F.concat(call, said)).when(F.col("type") == "tool", F.concat(call, result))
    return states.select("thread_id", "place", F.posexplode(rows).alias("part", "row")).select("thread_id", "place", "part", "row.role", "row.content")


def last_call(messages: DataFrame, key: str, order: str, value: str, wanted: Column) -> DataFrame:
    """(key, value) of each conversation's last message that is ``wanted``."""
    return messages.where(wanted).groupBy(key).agg(F.max_by(value, order).alias(value))


def last_state(states: DataFrame, key: str, order: str, limit: int = SCANNED) -> DataFrame:
    """The latest state of each conversation among the ``limit`` latest states of all."""
    recent = states.orderBy(F.desc(order), key).limit(limit)
    others = [c for c in states.columns if c != key]
    return recent.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in others])


def newest(messages: DataFrame, key: str, order: str, k: int = LISTED) -> DataFrame:
    """The ``k`` conversations with the latest message."""
    return messages.groupBy(key).agg(F.max(order).alias("latest")).orderBy(F.desc("latest"), key).limit(k)


def activity(updates: DataFrame) -> DataFrame:
    """(key, place, phase, label, detail): what each message of an update (key, place, step, type, text, name, calls) does.

    Tool calls with their arguments, else a tool's result cut to DETAIL, else, in the step ``model``, reasoning.
    """
    row = lambda phase, label, detail: F.struct(F.lit(phase).alias("phase"), label.alias("label"), detail.alias("detail"))
    calls = F.transform("calls", lambda c: row("tool_call", F.coalesce(c["name"], F.lit("tool")), F.coalesce(c["args"], F.lit("{}"))))
    result = F.array(row("tool_result", F.coalesce("name", F.lit("tool_result")), F.substring(F.coalesce("text", F.lit("")), 1, DETAIL)))
    thought = F.array(row("model", F.lit("agent_reasoning"), F.lit("Planning next response step")))
    events = F.when(F.size(F.coalesce("calls", F.array().cast(CALLS))) > 0, calls).when(F.col("type") == "tool", result).when(F.col("step") == "model", thought)
    return updates.select("key", "place", F.explode(events).alias("e")).select("key", "place", "e.*")

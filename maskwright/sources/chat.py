"""Chat requests, responses, event-stream lines and tool-message lines as tables."""

from __future__ import annotations

import json
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_column
from ..operators.joins import join_null_safe
from .lines import read_lines

_ENVELOPE = (
    "request_id string, ts timestamp, x_forwarded_for string, remote_addr string, x_session_id string, "
    "x_department string, x_role string, body string"
)
_TOOL_CALLS = "array<struct<function:struct<arguments:string>>>"


class ChatRequests(NamedTuple):
    """``requests``: one row per request; ``parts``: one row per text part, in reading
    order; ``rejects``: bodies that are no JSON or have no message array."""

    requests: DataFrame
    parts: DataFrame
    rejects: DataFrame


def _present(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def client_key() -> Column:
    """Who the usage limits count for."""
    return F.coalesce(
        _present(F.col("x_forwarded_for")), _present(F.col("remote_addr")), _present(F.col("x_session_id")), F.lit("default")
    )


def _array_of(body: Column, path: str) -> Column:
    """Elements of a JSON array as JSON texts; null where there is no array."""
    raw = F.get_json_object(body, path)
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>"))


def parse_requests(raw: DataFrame) -> ChatRequests:
    """Split request bodies into requests, text parts and rejects.

    Header fields win over body fields of the same meaning. A text part is a string
    content, a text block, or the arguments of a tool call.
    """
    body = F.col("body")
    parsed = raw.withColumn("_messages", _array_of(body, "$.messages"))
    rejects = parsed.filter("_messages IS NULL").drop("_messages")
    field = lambda name: F.get_json_object(body, f"$.{name}")
    good = parsed.filter("_messages IS NOT NULL").select(
        "request_id",
        "ts",
        client_key().alias("client"),
        F.coalesce(_present(F.col("x_session_id")), _present(field("user")), F.col("request_id")).alias("session_id"),
        F.coalesce(_present(F.col("x_department")), field("department")).alias("department"),
        F.coalesce(_present(F.col("x_role")), field("role")).alias("role"),
        F.lit("openai").alias("provider"),
        field("model").alias("model"),
        F.coalesce(field("stream") == "true", F.lit(False)).alias("is_streaming"),
        "_messages",
    )
    # What limits and screening see: contents joined by line ends, blocks as JSON.
    prompt = F.array_join(
        F.transform("_messages", lambda m: F.coalesce(F.get_json_object(m, "$.content"), F.lit("null"))), "\n"
    )
    requests = good.withColumn("prompt", prompt).drop("_messages")
    messages = good.select(
        "session_id", "ts", "request_id", F.posexplode("_messages").alias("turn", "_m")
    ).withColumn("message_role", F.get_json_object("_m", "$.role"))
    return ChatRequests(requests, message_parts(messages, "_m"), rejects)


def message_parts(messages: DataFrame, message: str) -> DataFrame:
    """One row per text part of a message: ``part_idx``, ``part_kind``, ``text``."""
    m = F.col(message)
    blocks = _array_of(m, "$.content")
    calls = F.from_json(F.get_json_object(m, "$.tool_calls"), _TOOL_CALLS)
    part = lambda kind, text: F.struct(F.lit(kind).alias("part_kind"), text.alias("text"))
    shape = "array<struct<part_kind:string,text:string>>"
    none = F.array().cast(shape)
    own = (
        F.when(blocks.isNotNull(), F.transform(blocks, lambda b: F.when(
            F.get_json_object(b, "$.type") == "text", part("block", F.get_json_object(b, "$.text")))))
        .when(F.get_json_object(m, "$.content").isNotNull(), F.array(part("content", F.get_json_object(m, "$.content"))))
        .otherwise(none)
    )
    args = F.coalesce(F.transform(calls, lambda c: part("tool_arg", c["function"]["arguments"])), none)
    keep = [c for c in messages.columns if c != message]
    return (
        messages.select(*keep, F.posexplode(F.concat(own.cast(shape), args.cast(shape))).alias("part_idx", "_p"))
        .filter("_p.text IS NOT NULL")
        .select(*keep, "part_idx", "_p.part_kind", "_p.text")
    )


def rebuild_messages(messages: DataFrame, message: str, parts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Put rewritten parts back into message JSON; other fields and blocks stay.

    ``parts`` holds ``keys``, ``part_idx``, ``part_kind`` and the rewritten text.
    """
    by_message = parts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("part_idx", text))).alias("_new")
    )
    joined = join_null_safe(messages, by_message, keys)
    return joined.withColumn(message, _rebuild(F.col(message), F.col("_new"))).drop("_new")


def _with_parts(raw: str | None, new) -> str | None:
    """One message with its new texts; the walk mirrors ``message_parts``."""
    if raw is None or new is None:
        return raw
    texts, message = dict(new), json.loads(raw)
    content = message.get("content")
    blocks = content if isinstance(content, list) else []
    for i, block in enumerate(blocks):
        if i in texts:
            block["text"] = texts[i]
    if isinstance(content, str):
        message["content"] = texts.get(0, content)
    first_call = len(blocks) if isinstance(content, list) else int(content is not None)
    for i, call in enumerate(message.get("tool_calls") or [], first_call):
        if i in texts:
            call["function"]["arguments"] = texts[i]
    return json.dumps(message, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def _rebuild(messages: pd.Series, news: pd.Series) -> pd.Series:
    return pd.Series([_with_parts(m, n) for m, n in zip(messages, news)], dtype=object)


def read_chat_requests(spark: SparkSession, path: str) -> ChatRequests:
    """JSON lines with header fields and the raw ``body``."""
    return parse_requests(spark.read.schema(_ENVELOPE).json(path))


# --- event streams -------------------------------------------------------------


def read_sse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Keep ``data:`` lines: adds ``delta`` (null for other payloads), ``done`` and
    ``passthrough`` (the line where there is nothing to rewrite)."""
    text = F.trim(as_column(line))
    body = F.substr(text, F.lit(7))
    is_data = text.startswith("data: ")
    done = text == "data: [DONE]"
    delta = F.when(is_data & ~done, F.nullif(F.get_json_object(body, "$.choices[0].delta.content"), F.lit("")))
    return (
        lines.withColumn("delta", delta)
        .withColumn("done", done)
        .withColumn("passthrough", F.when(F.col("delta").isNull() & ~F.col("done"), F.col(line)))
    )


def read_rpc(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON lines with ``is_json``, a session per file and ``seq``, the line's number in it.

    A last line without a line end is a line too.
    """
    return read_lines(spark, path).select(
        "line", F.col("file").alias("session_id"), F.col("line_no").alias("seq"),
        F.expr("try_parse_json(line) IS NOT NULL").alias("is_json"),
    )

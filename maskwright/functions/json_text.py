"""JSON texts as pieces: fixed text around string leaves.

Spark has no built-in that walks JSON of unknown shape, so parsing is one small
Arrow UDF. It cuts the text; finding, rewriting and putting together stay native.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import as_column, let

# kind 0: fixed text; 1: leaf to rewrite; 2: leaf to rewrite and to screen.
FIXED, LEAF, SCREENED = 0, 1, 2
PIECE = T.StructType([T.StructField("text", T.StringType()), T.StructField("kind", T.IntegerType())])
PIECES = T.ArrayType(PIECE)


def quote_json(col) -> Column:
    """A string as a JSON literal."""
    wrapped = F.to_json(F.struct(as_column(col).alias("v")))
    return let(wrapped, lambda j: F.substr(j, F.lit(6), F.length(j) - 6))


def _number(value: float) -> str:
    if value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return repr(value).replace("e-0", "e-").replace("e+0", "e+")


def _reject(token: str) -> None:
    raise ValueError(token)


def _everything(path: tuple) -> int:
    return LEAF


def _rpc_kind(message: Any):
    """Which leaves of a JSON-RPC message are rewritten: call arguments, tool texts
    (screened as well) and resource texts."""
    if not isinstance(message, dict):
        return lambda path: FIXED
    if message.get("result") and isinstance(message["result"], dict):
        items = message["result"].get("content")

        def from_server(path: tuple) -> int:
            if len(path) == 4 and path[0] == "result" and path[3] == "text":
                if path[1] == "content" and isinstance(items, list):
                    return SCREENED if items[path[2]].get("type") == "text" else FIXED
                if path[1] == "contents" and isinstance(path[2], int):
                    return LEAF
            return FIXED

        return from_server
    if message.get("method") in ("tools/call", "prompts/get"):
        return lambda path: LEAF if path[:2] == ("params", "arguments") else FIXED
    return lambda path: FIXED


def _result_kind(message: Any):
    """All leaves below ``result``."""
    return lambda path: LEAF if path[:1] == ("result",) else FIXED


_LONE = re.compile(r"\\u[dD][89a-fA-F]")


def _storable(value: Any) -> bool:
    try:
        json.dumps(value, ensure_ascii=False).encode()
        return True
    except (UnicodeEncodeError, RecursionError):
        return False


def cut(text: str, indent: int | None, kinds) -> list[tuple[str, int]] | None:
    """Pieces of a JSON text, or None if it is none or cannot be stored as text.

    Nesting too deep for the parser and lone surrogates, which no UTF-8 text can hold,
    count as no JSON: such a text is then searched as plain text.
    """
    try:
        value = json.loads(text, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None
    if "\\u" in text and _LONE.search(text) and not _storable(value):
        return None
    kind_of = kinds(value)
    out: list[list] = [["", FIXED]]

    def fixed(s: str) -> None:
        out[-1][0] += s

    # A stack of open containers instead of recursion: depth is bounded by memory only.
    todo: list[tuple] = [("value", value, (), "")]
    while todo:
        what, v, path, pad = todo.pop()
        if what == "text":
            fixed(v)
        elif isinstance(v, str):
            kind = kind_of(path)
            if kind == FIXED:
                fixed(json.dumps(v, ensure_ascii=False))
            else:
                out.extend([[v, kind], ["", FIXED]])
        elif isinstance(v, (dict, list)) and v:
            opening, closing = "{}" if isinstance(v, dict) else "[]"
            inner = pad if indent is None else pad + " " * indent
            gap, colon = ("", ":") if indent is None else ("\n" + inner, ": ")
            fixed(opening)
            later: list[tuple] = []
            for n, (key, item) in enumerate(v.items() if isinstance(v, dict) else enumerate(v)):
                name = json.dumps(key, ensure_ascii=False) + colon if isinstance(v, dict) else ""
                later.append(("text", ("," if n else "") + gap + name, (), ""))
                later.append(("value", item, path + (key,), inner))
            later.append(("text", closing if indent is None else "\n" + pad + closing, (), ""))
            todo += reversed(later)
        elif isinstance(v, float):
            fixed(_number(v))
        else:
            fixed(json.dumps(v))
    return [(s, k) for s, k in out if s or k]


def _cutter(indent: int | None, kinds):
    @F.pandas_udf(PIECES)
    def pieces(texts: pd.Series) -> pd.Series:
        def one(text):
            found = None if text is None else cut(text, indent, kinds)
            return None if found is None else [{"text": s, "kind": k} for s, k in found]

        return texts.map(one)

    return pieces


def document_pieces(col) -> Column:
    """All string leaves, printed with two spaces; null where the text is no JSON."""
    return _cutter(2, lambda message: _everything)(as_column(col))


def rpc_pieces(col) -> Column:
    """The leaves a JSON-RPC message has rewritten, printed compactly."""
    return _cutter(None, _rpc_kind)(as_column(col))


def result_pieces(col) -> Column:
    """All leaves of a JSON-RPC result, printed compactly."""
    return _cutter(None, _result_kind)(as_column(col))

"""Tolerant JSON: extraction from text, repair, and a schema score; an Arrow function over whole columns.

One reader takes a wide grammar - quotes of any kind, bare keys and words, comments, Python constants, missing or
spare commas, open ends - and notes each liberty. Strict input is strict_ok, input read to its end with liberties is
repaired, input whose end had to be dropped is partial, and input without any value is failed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTES = {'"': '"', "'": "'", "“": "”", "”": "”", "‘": "’", "«": "»"}
WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None, "undefined": None, "NaN": None}
FENCE = re.compile(r"```[a-zA-Z]*\s*\n?(.*?)```", re.S)
COMMENT = re.compile(r"/\*|\s//|\s#")
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$")


def extract(text: str) -> str:
    """The first code fence, else from the first bracket to the last that closes."""
    if m := FENCE.search(text):
        return m[1].strip()
    begin = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return text.strip()
    end = max(text.rfind("}"), text.rfind("]"))
    return text[begin : end + 1] if end > begin else text[begin:]


class Reader:
    def __init__(self, text: str) -> None:
        self.t, self.i, self.fixes, self.dropped = text, 0, 0, 0

    def blank(self) -> None:
        while self.i < len(self.t):
            if self.t[self.i].isspace():
                self.i += 1
            elif self.t.startswith(("//", "#"), self.i):
                self.fixes += 1
                self.i = (self.t.find("\n", self.i) + 1) or len(self.t)
            elif self.t.startswith("/*", self.i):
                self.fixes += 1
                end = self.t.find("*/", self.i)
                self.i = end + 2 if end >= 0 else len(self.t)
            else:
                return

    def peek(self) -> str:
        self.blank()
        return self.t[self.i] if self.i < len(self.t) else ""

    def string(self) -> str:
        first = self.t[self.i]
        close, out = QUOTES[first], []
        self.fixes += first != '"'
        self.i += 1
        while self.i < len(self.t):
            c = self.t[self.i]
            self.i += 1
            if c == close or (first == "“" and c == '"'):
                return "".join(out)
            if c == "\\" and self.i < len(self.t):
                e = self.t[self.i]
                self.i += 1
                if e == "u" and re.match(r"[0-9a-fA-F]{4}", self.t[self.i :]):
                    out.append(chr(int(self.t[self.i : self.i + 4], 16)))
                    self.i += 4
                else:
                    out.append({"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(e, e))
            else:
                out.append(c)
        self.fixes += 1
        return "".join(out)

    def word(self, stops: str) -> str:
        begin = self.i
        while self.i < len(self.t) and self.t[self.i] not in stops:
            self.i += 1
        if m := COMMENT.search(self.t, begin, self.i):
            self.i = m.start()
        return self.t[begin : self.i].strip()

    def value(self) -> object:
        c = self.peek()
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c in QUOTES and c:
            return self.string()
        w = self.word(",}]\n")
        if w in WORDS:
            self.fixes += w not in ("true", "false", "null")
            return WORDS[w]
        if NUMBER.match(w):
            return json.loads(w)
        if not w:
            raise ValueError("no value")
        self.fixes += 1
        return w

    def object(self) -> dict:
        self.i += 1
        out: dict = {}
        comma = True
        while True:
            c = self.peek()
            if not c:
                self.fixes += 1
                return out
            if c in "}]":
                self.i += 1
                self.fixes += (c == "]") + bool(out and comma)
                return out
            if c == ",":
                self.i += 1
                self.fixes += comma
                comma = True
                continue
            begin = self.i
            if c in QUOTES:
                key = self.string()
            else:
                key = self.word(":,}]")
                self.fixes += 1
            if self.peek() != ":":
                self.dropped += self.i - begin  # words that are no pair
                self.fixes += 1
                continue
            self.fixes += not comma
            self.i += 1
            if not self.peek() or self.peek() in ",}":
                self.fixes += 1
                out[key] = None
            else:
                out[key] = self.value()
            comma = False

    def array(self) -> list:
        self.i += 1
        out: list = []
        comma = True
        while True:
            c = self.peek()
            if not c:
                self.fixes += 1
                return out
            if c in "}]":
                self.i += 1
                self.fixes += (c == "}") + bool(out and comma)
                return out
            if c == ",":
                self.i += 1
                self.fixes += comma
                comma = True
                continue
            self.fixes += not comma
            out.append(self.value())
            comma = False


def repair(text: str | None) -> tuple[str, str | None, float]:
    """(status, JSON text, confidence)."""
    if not text or not text.strip():
        return "failed", None, 0.0
    try:
        return "strict_ok", json.dumps(json.loads(text), ensure_ascii=False), 1.0
    except (ValueError, RecursionError):
        pass
    body = extract(text)
    r = Reader(body)
    try:
        if r.peek() not in ("{", "["):
            return "failed", None, 0.0
        v = r.value()
    except (ValueError, RecursionError):
        return "failed", None, 0.0
    r.blank()
    r.dropped += len(body) - r.i
    r.fixes += body != text.strip()
    sure = max(0.05, 0.95 ** max(1, r.fixes)) * (1 - min(0.9, r.dropped / max(1, len(body))))
    return ("partial" if r.dropped else "repaired"), json.dumps(v, ensure_ascii=False), round(sure, 6)


RESULT = T.StructType([T.StructField("status", T.StringType()), T.StructField("json", T.StringType()), T.StructField("confidence", T.DoubleType())])


@F.pandas_udf(RESULT)
def repair_json(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repair(t) for t in texts], columns=["status", "json", "confidence"])


def schema_score(text: str, required: list[str], types: dict[str, str]) -> float:
    """Half for required fields that are there, half for fields of the right type; 0 for anything but an object."""
    v = json.loads(text) if text else None
    if not isinstance(v, dict):
        return 0.0
    kinds = {"string": str, "number": (int, float), "boolean": bool, "array": list, "object": dict}
    have = sum(k in v for k in required) / len(required) if required else 1.0
    right = sum(k in v and isinstance(v[k], kinds[t]) and not (t == "number" and isinstance(v[k], bool)) for k, t in types.items()) / len(types) if types else 1.0
    return 0.5 * have + 0.5 * right


def patched(text: str, ops: list[tuple[str, int, int, str]]) -> str:
    """insert, replace and delete on UTF-8 byte spans of the text as it was; later spans first."""
    raw = text.encode()
    for kind, a, b, new in sorted(ops, key=lambda o: -o[1]):
        raw = raw[:a] + (b"" if kind == "delete" else new.encode()) + raw[a if kind == "insert" else b :]
    return raw.decode(errors="replace")


def schema_scores(required: list[str], types: dict[str, str]) -> Callable[[Column], Column]:
    """schema_score over a column; text that isn't JSON scores 0."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(schema_score(t, required, types))
            except ValueError:
                out.append(0.0)
        return pd.Series(out, dtype="float64")

    return score


def op(kind: str, start: int, end: int, new: Column | str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(start).alias("start"), F.lit(end).alias("end"), (F.lit(new) if isinstance(new, str) else new).alias("new"))


@F.pandas_udf(T.StringType())
def patched_text(texts: pd.Series, ops: pd.Series) -> pd.Series:
    """patched over columns: the operations of a text as an array of op(); null texts stay null."""
    return pd.Series([None if t is None else patched(t, [(o["kind"], o["start"], o["end"], o["new"]) for o in todo]) for t, todo in zip(texts, ops, strict=True)])


def items_text(json: Column) -> Column:
    """A JSON array of named quantities as text."""
    items = F.from_json(json, "array<struct<name:string,quantity:string>>")
    return F.array_join(F.transform(items, lambda x: F.concat(x["name"], F.lit(" x "), x["quantity"])), "; ")


def root_items(df: DataFrame, text: str) -> DataFrame:
    """df without the text, with a row (nth, item) for each element of its root array as JSON text, so that work on a large array is dealt out."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.from_json(text, "array<string>")).alias("nth", "item"))

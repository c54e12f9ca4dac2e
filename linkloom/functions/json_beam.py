"""JSON repair as a beam search: several readings of a broken text, each with its cost, ranked.

A text is cut into tokens that never fail. A state is a place among them, the open brackets with what each waits for,
and what was written. Where a token doesn't fit, the search goes several ways - insert what is missing, drop the token,
take a bare word as a string, close a bracket - each at a price; the cheapest states go on. Confidence is what a
reading's price leaves against the others'.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r'''[{}\[\]:,]|"(?:[^"\\]|\\.)*"?|'(?:[^'\\]|\\.)*'?|[^\s{}\[\]:,"']+''')
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$")
WORDS = {"true": "true", "false": "false", "null": "null", "True": "true", "False": "false", "None": "null", "undefined": "null"}
#: Prices of what may be done to a token, or in place of one.
MISSING, DROP, BARE, CLOSE, QUOTE, NULL, TRAILING = 0.6, 1.0, 0.4, 0.5, 0.15, 1.2, 0.2


@dataclass(frozen=True)
class State:
    """stack: open brackets with what each waits for: key, colon, value, comma."""

    at: int = 0
    stack: tuple[tuple[str, str], ...] = ()
    out: tuple[str, ...] = ()
    cost: float = 0.0
    fixes: int = 0
    dropped: int = 0
    closed: int = 0
    strings: int = 0
    done: bool = field(default=False)


def scalar(token: str) -> tuple[str, float, int] | None:
    """(JSON, price, closed strings) of a token that can be a value."""
    if token[0] in "{}[]:,":
        return None
    if token[0] in "\"'":
        whole = len(token) > 1 and token[-1] == token[0]
        body = token[1:-1] if whole else token[1:]
        try:
            text = json.loads(f'"{body}"') if token[0] == '"' else body.replace("\\'", "'")
        except ValueError:
            text = body
        return json.dumps(text, ensure_ascii=False), (0.0 if token[0] == '"' else QUOTE) + (0.0 if whole else CLOSE), int(not whole)
    if NUMBER.match(token):
        return token, 0.0, 0
    if token in WORDS:
        return WORDS[token], 0.0 if token in ("true", "false", "null") else 0.1, 0
    return json.dumps(token, ensure_ascii=False), BARE, 0


def moved(s: State, stack: tuple, add: tuple[str, ...], price: float, step: int = 1, **more: int) -> State:
    return State(s.at + step, stack, s.out + add, s.cost + price, s.fixes + (price > 0), s.dropped + more.get("dropped", 0), s.closed + more.get("closed", 0), s.strings + more.get("strings", 0), not stack)


def after_value(stack: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...]:
    return (*stack[:-1], (stack[-1][0], "comma")) if stack else ()


def ways(s: State, token: str | None) -> list[State]:
    """What may follow: the token as it fits, or a repair."""
    if s.done:
        return [] if token is None else [State(s.at + 1, (), s.out, s.cost + DROP, s.fixes + 1, s.dropped + 1, s.closed, s.strings, True)]
    if not s.stack and not s.out:  # the root
        if token is None:
            return []
        if token in "{[":
            return [moved(s, ((token, "key" if token == "{" else "value"),), (token,), 0.0)]
        one = scalar(token)
        found = [State(s.at + 1, (), s.out, s.cost + DROP, s.fixes + 1, s.dropped + 1, s.closed, s.strings, False)]
        return found + ([moved(s, (), (one[0],), one[1], strings=one[2])] if one else [])
    kind, wants = s.stack[-1]
    close = "}" if kind == "{" else "]"
    up = after_value(s.stack[:-1])
    bare = s.out[:-1] if s.out[-1] == "," else s.out
    if token is None:
        if wants == "colon":
            return [moved(s, (*s.stack[:-1], (kind, "comma")), (":", "null"), NULL, 0)]
        if wants == "value" and kind == "{":
            return [moved(s, (*s.stack[:-1], (kind, "comma")), ("null",), NULL, 0)]
        return [State(s.at, up, (*bare, close), s.cost + CLOSE, s.fixes + 1, s.dropped, s.closed + 1, s.strings, not s.stack[:-1])]
    out: list[State] = [State(s.at + 1, s.stack, s.out, s.cost + DROP + 0.01 * len(token), s.fixes + 1, s.dropped + 1, s.closed, s.strings)]
    if token in "}]":
        if wants in ("comma",) or s.out[-1] in "{[,":
            price = (0.0 if token == close else MISSING) + (TRAILING if s.out[-1] == "," else 0.0)
            step = 1 if token == close else 0
            out.append(State(s.at + step, up, (*bare, close), s.cost + price, s.fixes + (price > 0), s.dropped, s.closed + (step == 0), s.strings, not s.stack[:-1]))
        elif wants == "value":
            out.append(moved(s, (*s.stack[:-1], (kind, "comma")), ("null",), NULL, 0))
        return out
    if wants == "comma":
        nxt = (*s.stack[:-1], (kind, "key" if kind == "{" else "value"))
        if token == ",":
            out.append(moved(s, nxt, (",",), 0.0))
        elif token != ":":
            out.append(moved(s, nxt, (",",), MISSING, 0))
        return out
    if wants == "colon":
        nxt = (*s.stack[:-1], (kind, "value"))
        out.append(moved(s, nxt, (":",), 0.0 if token == ":" else MISSING, int(token == ":")))
        return out
    if wants == "key":
        one = scalar(token)
        if one:
            name = one[0] if one[0][0] == '"' else json.dumps(one[0])
            out.append(moved(s, (*s.stack[:-1], (kind, "colon")), (name,), one[1] if token[0] in "\"'" else max(one[1], BARE), strings=one[2]))
        return out
    if token in "{[":
        stack = (*after_value(s.stack), (token, "key" if token == "{" else "value"))
        out.append(moved(s, stack, (token,), 0.0))
        return out
    one = scalar(token)
    if one:
        out.append(moved(s, after_value(s.stack), (one[0],), one[1], strings=one[2]))
    elif kind == "{":
        out.append(moved(s, after_value(s.stack), ("null",), NULL, 0))
    return out


def readings(text: str, k: int = 5, beam: int = 32) -> list[dict]:
    """Up to k distinct readings, ranked."""
    tokens = TOKEN.findall(text)
    live, ends = [State()] if tokens else [], {}
    for _ in range(4 * len(tokens) + 64):
        nxt: dict[tuple, State] = {}
        for s in live:
            token = tokens[s.at] if s.at < len(tokens) else None
            if s.done and token is None:
                ends.setdefault(s.out, s)
                if s.cost < ends[s.out].cost:
                    ends[s.out] = s
                continue
            for n in ways(s, token):
                key = (n.at, n.stack, n.out, n.done)
                if key not in nxt or n.cost < nxt[key].cost:
                    nxt[key] = n
        live = sorted(nxt.values(), key=lambda s: s.cost)[:beam]
        if not live:
            break
    found = []
    for s in ends.values():
        try:
            found.append((s, json.dumps(json.loads("".join(s.out)), ensure_ascii=False)))
        except (ValueError, RecursionError):
            continue
    total = sum(math.exp(-s.cost) for s, _ in found) or 1.0
    rows = [{"json": j, "confidence": round(math.exp(-s.cost) / total, 6), "cost": round(s.cost, 6), "dropped": s.dropped, "strings": s.strings, "closed": s.closed, "fixes": s.fixes} for s, j in found]
    return ranked(rows)[:k]


def ranked(rows: list[dict]) -> list[dict]:
    """By nine keys: the schema's match (0 without one), confidence, cost, dropped tokens, closed strings, closed brackets, length, repairs, and the order found."""
    keyed = sorted(enumerate(rows), key=lambda p: (-p[1].get("schema", 0.0), -p[1]["confidence"], p[1]["cost"], p[1]["dropped"], p[1]["strings"], p[1]["closed"], -len(p[1]["json"]), p[1]["fixes"], p[0]))
    return [r for _, r in keyed]


RESULT = T.ArrayType(T.StructType([T.StructField("json", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("cost", T.DoubleType()), T.StructField("fixes", T.IntegerType())]))


def candidates(k: int = 5, beam: int = 32) -> Callable[[Column], Column]:
    """The k best readings of a column of texts, none for null or empty ones."""

    @F.pandas_udf(RESULT)
    def read(texts: pd.Series) -> pd.Series:
        seen: dict[str, list[dict]] = {}
        out = []
        for t in texts:
            if t not in seen:
                seen[t] = [{c: r[c] for c in ("json", "confidence", "cost", "fixes")} for r in readings(t, k, beam)] if t else []
            out.append(seen[t])
        return pd.Series(out)

    return read

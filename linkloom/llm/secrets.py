"""Secret scans: three stated patterns, and a token-efficiency test that finds random strings beside them.

A run of token characters is random-looking if a byte-level vocabulary needs many tokens for it: under `most_ratio`
characters a token, over the whole run or over a part of it between separators. Runs of `least` characters or more (16
by default) are taken from whole texts; each distinct run is encoded once. Left out are runs that are known digests
(hexadecimal of the lengths of MD5, SHA-1, SHA-2, a UUID), those without letters (numbers, dates, addresses), and
identifiers: runs whose letters are for the most part words of the vocabulary, three letters or more each, as _, -, ., /
and capitals divide them, and paths of single letters. What the patterns found stays in any case; a random run that
touches one of those spans is not reported again.

Defined cases: null and empty texts have no spans; texts are whole, of any length; repeated rows give repeated rows;
input columns named like the new ones are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import add_columns

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "random")
#: The parts that capitals divide a run's letters in.
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
SEPARATORS = re.compile(r"[_./=+-]+")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the stated patterns, in order."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    return sorted(out)


class Scanner:
    def __init__(self, ranks: dict[bytes, int], pattern: str, most_ratio: float, least: int = 16) -> None:
        import tiktoken

        self.count = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ranks, self.most_ratio, self.least = ranks, most_ratio, least
        self.run = re.compile(rf"[A-Za-z0-9+/_=.-]{{{least},}}")
        self.seen: dict[str, bool] = {}

    def random(self, run: str) -> bool:
        hit = self.seen.get(run)
        if hit is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            parts = {run, *SEPARATORS.split(run)}
            hit = self.seen[run] = not DIGEST.fullmatch(run) and any(len(p) >= self.least and self.dense(p) and not self.identifier(p) for p in parts)
        return hit

    def dense(self, run: str) -> bool:
        """Whether a run has too few characters a token."""
        return len(run) < self.most_ratio * len(self.count(run))

    def word(self, part: str) -> bool:
        low = part.lower()
        return any(w.encode() in self.ranks for x in (part, low, low.capitalize()) for w in (x, " " + x))

    def identifier(self, run: str) -> bool:
        """Whether a run has no letters, or words of the vocabulary make up most of them, or single letters do."""
        parts = PART.findall(run)
        words = sum(len(p) for p in parts if len(p) >= 3 and self.word(p))
        return not parts or words >= 0.6 * sum(map(len, parts)) or 3 * sum(map(len, SEPARATORS.findall(run))) > len(run)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        out = base_spans(text)
        more = []
        for m in self.run.finditer(text):
            run = m[0].strip(".-/=")
            a = m.start() + m[0].index(run) if run else 0
            if len(run) >= self.least and self.random(run) and not any(s < a + len(run) and a < e for s, _, e in out):
                more.append((a, 3, a + len(run)))
        return sorted(out + more)

    def __call__(self, texts: list[str]) -> list[pa.Array]:
        return [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in self.spans(t)] for t in texts], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]


def ranks_of(vocabulary_path: str) -> dict[bytes, int]:
    with open(vocabulary_path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def scan(df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", most_ratio: float = 2.0, least: int = 16) -> DataFrame:
    """df with spans array<struct<kind, start, end>> in code points, by start, then kind as in KINDS.

    most_ratio: a run with fewer characters a token is random; least: characters of the shortest runs that are tested. The vocabulary file, of a fixed size of 1 MB, is read on
    the driver and sent with the tasks.
    """
    with open(vocabulary_path, "rb") as f:
        raw = f.read()

    def make() -> Callable[[list[str]], list[pa.Array]]:
        return Scanner({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, pattern, most_ratio, least)

    return add_columns(df, text, make, [T.StructField("spans", SPAN)])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, spans: str = "spans", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of its text replaced by the mark; overlapping spans get one mark. Null texts stay null."""
    step = lambda acc, s: F.struct(
        F.when(s["end"] <= acc["at"], acc["out"])
        .when(s["start"] < acc["at"], acc["out"])
        .otherwise(F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
        .alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(F.col(text))))
    clean = F.aggregate(F.col(spans), F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, rest)
    return df.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text)))

"""Table functions that cut messages: by intent marker, and into chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Words that begin an offer or a request.
OFFER = re.compile(r"(?i)(?:^|[\s\n📌💊✅])(?:موجود|متوفر|عندي|عندنا|يوجد|للبيع|available|i\s*have|for\s*sale|selling|in\s*stock)")
REQUEST = re.compile(r"(?i)(?:^|[\s\n📢🔊❗])(?:مطلوب|محتاج|عايز|نقص|ابغى|wanted|need|looking\s*for|required|searching\s*for)")


def segments(text: str) -> list[tuple[int, str, str | None, str]]:
    """(number, intent, marker, text) in order: what stands behind a marker up to the next one, if anything does.

    What stands before the first marker is Unknown; a text without markers is one Unknown segment, untouched.
    """
    marks = sorted([(m.start(), m.end(), "Offer", m[0].strip()) for m in OFFER.finditer(text)] + [(m.start(), m.end(), "Request", m[0].strip()) for m in REQUEST.finditer(text)])
    if not marks:
        return [(0, "Unknown", None, text)]
    ends = [m[0] for m in marks[1:]] + [len(text)]
    parts = [("Unknown", None, text[: marks[0][0]].strip())] + [(k, word, text[b : max(b, e)].strip()) for (_, b, k, word), e in zip(marks, ends, strict=True)]
    return [(i, *p) for i, p in enumerate(p for p in parts if p[2])]


def mixed(text: str) -> bool:
    """Whether a text has markers of both kinds."""
    return bool(OFFER.search(text) and REQUEST.search(text))


def chunks(text: str, most: int) -> list[str]:
    """A text of over `most` characters in pieces, cut behind the last line feed, else blank, else Arabic comma, else at the limit; trimmed, blank ones left out."""
    if len(text) <= most:
        return [text] if text else []
    out, at = [], 0
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            head = text[at:end]
            end = at + next((p + 1 for c in ("\n", " ", "\u060c") if (p := head.rfind(c)) >= 0), most)
        out.append(text[at:end].strip())
        at = end
    return [c for c in out if c] or [text]


def line_chunks(text: str, lines: int, most: int, depth: int = 0) -> list[str]:
    """Chunks of so many lines, five fewer (three at least) for each depth; a text of no more lines is cut by characters."""
    rows, few = text.split("\n"), max(3, lines - 5 * depth)
    rows = [r.removesuffix("\r") for r in (rows[:-1] if rows and not rows[-1] else rows)]
    if len(rows) <= few:
        return chunks(text, most)
    return ["\n".join(rows[i : i + few]) for i in range(0, len(rows), few)]


@udtf(returnType="number int, intent string, marker string, segment string")
class SplitByIntent:
    def eval(self, text: str) -> Iterator[tuple[int, str, str | None, str]]:
        yield from segments(text or "")


@udtf(returnType="number int, chunk string")
class ChunkText:
    def eval(self, text: str, most: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunks(text or "", most))


@udtf(returnType="number int, chunk string")
class ChunkLines:
    def eval(self, text: str, lines: int, most: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(line_chunks(text or "", lines, most))


def register(spark: SparkSession) -> None:
    spark.udtf.register("split_by_intent", SplitByIntent)
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("chunk_lines", ChunkLines)

"""Token counts that follow edits: a tree of sums over pre-tokens for each document.

Pre-tokens are the pieces that the vocabulary's pattern cuts a text in; each is encoded alone, so a document's count is
the sum of its pre-tokens' counts. A document's pre-tokens are kept in leaves, each with its piece of the text, below a
binary tree of sums (characters, tokens). An edit finds the leaf of its place in the tree, cuts the text anew from two
pre-tokens before the edit until the new cuts meet the old ones again behind it, encodes only those, and corrects the
sums on the way to the root. Leaves of over 2 LEAF pre-tokens are split. The boundary context of the pattern is a run of
blanks and the pre-token beside it.

index() gives each document its tree as a column, to be kept as a table; edited() applies a table of edits to such a
table and encodes only what they touch, documents without edits not at all. counts() does both in one pass, with edits
that are made from the text, and keeps no tree.

Defined cases: null and empty texts have count 0; edits are (start, end, replacement) in code points of the text before
all edits, and don't overlap; two at one place are applied in the order of their replacements; null replacements are
empty; edits of ids that aren't there, with a null id or place do nothing; texts are whole, of any length; repeated rows
give repeated rows, and edits of their id go to each; input columns named like the new ones are replaced, others stay;
an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import add_columns, small_batches, unused

LEAF = 64
MOST_KNOWN = 300_000


class Counter:
    """Tokens of a pre-token, each distinct one encoded once."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.cut = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > MOST_KNOWN:
                self.known.clear()
            n = self.known[piece] = len(self.encode(piece.encode("utf-8", "surrogatepass")))
        return n


Leaf = tuple[str, list[int], list[int]]


class Tree:
    """A document's pre-tokens in leaves (text, characters of each, tokens of each), and sums of (characters, tokens) above."""

    def __init__(self, text: str, counter: Counter, kept: list[tuple[list[int], list[int]]] | None = None) -> None:
        """kept: the characters and tokens of each leaf's pre-tokens, of a tree of this text that was kept."""
        self.counter, self.encoded = counter, 0
        if kept is None:
            pieces = counter.cut.findall(text)
            self.leaves = self.in_leaves(text, [len(p) for p in pieces], [counter.count(p) for p in pieces])
        else:
            ends = [0]
            for chars, _ in kept:
                ends.append(ends[-1] + sum(chars))
            self.leaves = [(text[a:b], list(chars), list(tokens)) for a, b, (chars, tokens) in zip(ends, ends[1:], kept, strict=False)] or [("", [], [])]
        self.grow()

    @staticmethod
    def in_leaves(text: str, chars: list[int], tokens: list[int], most: int = LEAF) -> list[Leaf]:
        out, at = [], 0
        for i in range(0, len(chars), most):
            n = sum(chars[i : i + most])
            out.append((text[at : at + n], chars[i : i + most], tokens[i : i + most]))
            at += n
        return out or [("", [], [])]

    def grow(self) -> None:
        """All sums anew."""
        self.size = 1
        while self.size < len(self.leaves):
            self.size *= 2
        self.sums = [(0, 0)] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.sums[self.size + i] = (len(leaf[0]), sum(leaf[2]))
        for i in range(self.size - 1, 0, -1):
            a, b = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a[0] + b[0], a[1] + b[1])

    @property
    def text(self) -> str:
        return "".join(leaf[0] for leaf in self.leaves)

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    @property
    def chars(self) -> int:
        return self.sums[1][0]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it begins."""
        i, base = 1, 0
        while i < self.size:
            i *= 2
            if at >= base + self.sums[i][0] and self.sums[i + 1][0]:
                base += self.sums[i][0]
                i += 1
        return min(i - self.size, len(self.leaves) - 1), base

    def put(self, k: int, leaf: Leaf) -> None:
        self.leaves[k] = leaf
        i = self.size + k
        self.sums[i] = (len(leaf[0]), sum(leaf[2]))
        while i > 1:
            i //= 2
            a, b = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a[0] + b[0], a[1] + b[1])

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters [start, end) of the present text."""
        first, base = self.find(max(start - 1, 0))
        last = max(first, self.find(end)[0])

        def before() -> int:
            """How many pre-tokens from the first leaf on end before the edit."""
            at = n = 0
            for leaf in self.leaves[first : last + 1]:
                for size in leaf[1]:
                    at += size
                    if base + at >= start:
                        return n
                    n += 1
            return n

        # two pre-tokens before the edit: the one that touches it, and blanks whose cut depends on what follows
        while (n := before()) < 2 and first:
            first -= 1
            base -= self.sums[self.size + first][0]
        keep = max(n - 2, 0) if first or n >= 2 else 0
        while True:
            part = self.leaves[first : last + 1]
            old, chars, tokens = "".join(p[0] for p in part), [x for p in part for x in p[1]], [x for p in part for x in p[2]]
            text = old[: start - base] + new + old[end - base :]
            shift, at = len(new) - (end - start), sum(chars[:keep])
            cuts, place = {}, 0  # old cuts behind the edit, where they are now
            for i, size in enumerate(chars):
                if place >= end - base:
                    cuts[place + shift] = i
                place += size
            made: list[tuple[int, int]] = []
            rest = None
            for m in self.counter.cut.finditer(text, at):
                if m.start() >= start - base + len(new) and m.start() in cuts and not text[m.start() - 1].isspace():
                    rest = cuts[m.start()]
                    break
                made.append((m.start(), m.end()))
            if rest is not None or last == len(self.leaves) - 1:
                break
            last += 1  # the cuts don't meet yet
        rest = len(chars) if rest is None else rest
        self.encoded += len(made)
        chars = chars[:keep] + [b - a for a, b in made] + chars[rest:]
        tokens = tokens[:keep] + [self.counter.count(text[a:b]) for a, b in made] + tokens[rest:]
        leaves = [(text, chars, tokens)] if len(chars) <= 2 * LEAF else self.in_leaves(text, chars, tokens)
        if len(leaves) == last - first + 1:
            for i, leaf in enumerate(leaves):
                self.put(first + i, leaf)
        else:
            self.leaves[first : last + 1] = leaves
            self.grow()


def counter_of(vocabulary_path: str, pattern: str) -> Callable[[], Counter]:
    """The vocabulary file, of a fixed size of 1 MB, is read on the driver and sent along."""
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()
    return lambda: Counter(vocabulary, pattern)


TREE = T.ArrayType(T.StructType([T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))]))
ARROW_TREE = pa.list_(pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))]))


def kept(tree: Tree) -> list[dict]:
    return [{"chars": leaf[1], "tokens": leaf[2]} for leaf in tree.leaves]


def index(df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with n_tokens long and tree array<struct<chars, tokens>>: of each leaf, the characters and tokens of its pre-tokens."""
    counter = counter_of(vocabulary_path, pattern)

    def make():
        c = counter()

        def fn(texts: list[str]) -> list[pa.Array]:
            trees = [Tree(t, c) for t in texts]
            return [pa.array([t.tokens for t in trees], pa.int64()), pa.array([kept(t) for t in trees], ARROW_TREE)]

        return fn

    return add_columns(df, text, make, [T.StructField("n_tokens", T.LongType()), T.StructField("tree", TREE)])


def edited(df: DataFrame, edits: DataFrame, vocabulary_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What index() gave after the edits (doc_id, start, end, replacement), with n_reencoded long. A document's edits are held together, which don't overlap."""
    counter = counter_of(vocabulary_path, pattern)
    todo, again = unused(df, "edits"), unused(df, "of")
    own = edits.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).groupBy(F.col(doc_id).alias(again))
    own = own.agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long"), F.col("end").cast("long"), F.coalesce("replacement", F.lit(""))))).alias(todo))
    src = df.drop("n_reencoded").join(own, F.col(doc_id) == F.col(again), "left").drop(again)
    names = src.columns
    at = {n: names.index(n) for n in (text, "n_tokens", "tree", todo)}
    schema = T.StructType([*[f for f in src.schema.fields if f.name != todo], T.StructField("n_reencoded", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter()
        for b in batches:
            texts, trees, counted, encoded = [], [], [], []
            for t, leaves, n, change in zip(*(b.column(at[k]).to_pylist() for k in (text, "tree", "n_tokens", todo)), strict=True):
                done = 0
                if change and leaves is not None:
                    tree = Tree(t or "", c, [(x["chars"], x["tokens"]) for x in leaves])
                    for x in reversed(change):
                        tree.edit(*x.values())
                    t, leaves, n, done = tree.text, kept(tree), tree.tokens, tree.encoded
                texts.append(t)
                trees.append(leaves)
                counted.append(n)
                encoded.append(done)
            new = {text: pa.array(texts, pa.string()), "tree": pa.array(trees, ARROW_TREE), "n_tokens": pa.array(counted, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(i)) for i, n in enumerate(names) if n != todo] + [pa.array(encoded, pa.int64())], names=schema.names)

    return small_batches(src).mapInArrow(run, schema)


def counts(df: DataFrame, vocabulary_path: str, pattern: str, edits: Callable[[str], list[tuple[int, int, str]]], text: str = "text") -> DataFrame:
    """df with n_pretokens, n_tokens, n_edits, n_reencoded, n_tokens_after (all long) and edited string. edits: from a text its edits."""
    of = counter_of(vocabulary_path, pattern)

    def make():
        counter = of()

        def fn(texts: list[str]) -> list[pa.Array]:
            out = []
            for t in texts:
                tree = Tree(t, counter)
                before, pieces = tree.tokens, sum(len(leaf[1]) for leaf in tree.leaves)
                todo = sorted(edits(t), reverse=True)
                for start, end, new in todo:
                    tree.edit(start, end, new)
                out.append((pieces, before, len(todo), tree.encoded, tree.tokens, tree.text))
            cols = list(zip(*out, strict=True)) or [()] * 6
            return [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.string())]

        return fn

    names = ["n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after"]
    return add_columns(df, text, make, [T.StructField(n, T.LongType()) for n in names] + [T.StructField("edited", T.StringType())])


NUMBERS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{5,}")
MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.\w+)+")


def scrub(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace e-mail addresses, IP addresses and long numbers by a mark."""
    mails = [(m.start(), m.end(), "<mail>") for m in MAIL.finditer(text)] if "@" in text else []
    return mails + [(m.start(), m.end(), "<num>") for m in NUMBERS.finditer(text) if not any(a < m.end() and m.start() < b for a, b, _ in mails)]

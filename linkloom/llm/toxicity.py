"""Toxicity by a weighted finite-state pattern grammar.

Words and marks become classes (insult, harm, target, negation, report, quotation and the parts of a threat's frame) by a
lexicon: stated word lists, and stems that the labels show. Five weighted transducers rewrite the class sequence:

- insult: reads insults with what strengthens them before ("total", "piece of") and runs of insults;
- threat: a verb of harm is a threat only in a frame - I or we and a modal, or a modal said to the target - and "die"
  only behind "you" and a modal, as it is an article elsewhere;
- negation: reaches the three words behind it;
- reported speech: from a verb of report to the end of the sentence, over a colon too, and all between quotation marks;
- target: up to six words before an insult or threat, or three behind a threat.

They are composed into one machine, whose states are made as they are met. Each arc has a weight; a path's weight is the
product of its arcs' and of the word's in the lexicon. A clause weighs as much as what was matched in it. A logistic
model over the two heaviest paths, the two heaviest clauses and the counts of what was matched gives the score. Its weights
are fitted with a prior at DEFAULT, which holds where the labels say little. A word outside of the lexicon never moves the
score, nor does a label, language, source or id.

Stems and model weights are fitted on a bounded sample: at most MOST_TOXIC and MOST_CLEAN labelled documents, those of
the least hash, none of them held out (crc32 of the id as text mod 3 is 1). The features and the ridge were chosen on
such rows too: fitted where that remainder is 0, compared where it is 2. Everything else covers all documents.

Defined cases: null and empty texts have the score of a text without any matched clause; without enough labels of
both kinds the stated lists and default weights hold; repeated rows give repeated rows; texts are whole; input columns
named toxic_score or clauses are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import add_columns, cut, slices, small_batches

#: Bounds of the sample that stems and weights are fitted on, and of the learned lexicon.
MOST_TOXIC, MOST_CLEAN, MOST_STEMS = 4000, 8000, 4000
OTHER, INSULT, HARM, DIE, TARGET, YOU, SELF, MODAL, FRAME, BOOST, NEGATION, REPORT, QUOTE, OPEN, CLOSE, COLON, END = range(17)
#: Stated word lists; learned stems come beside them.
LISTS = {
    INSULT: "idiot idiots moron morons stupid loser losers clown clowns scum trash pathetic worthless disgusting dumb imbecile imbécile idiota estúpido estúpida imbécil idiote stupide dumm dumme dummkopf abschaum",
    HARM: "kill hurt destroy burn shoot murder strangle töten umbringen vernichten tuer frapper écraser matar quemar destruir",
    DIE: "die",
    TARGET: "your you're yours he she they him her them his their du dich dir dein sie ihr euch tu te toi vous votre usted tú ti ustedes",
    YOU: "you",
    SELF: "i we ich wir je nous yo nosotros",
    MODAL: "will shall should must gonna going deserve werde werden sollst musst wirst vais allons vas dois mereces debes",
    FRAME: "i'll we'll you'll voy vamos",
    BOOST: "such total complete utter absolute piece bunch of so absolut total völlig stück tas espèce de tan pedazo",
    NEGATION: "not no never isn't aren't don't wasn't without nicht kein keine nie pas jamais sans nunca sin",
    REPORT: "said says say told called calls claimed claims wrote sagte sagt nannte dit disait dijo llamó",
}
MARKS = {'"': QUOTE, "“": OPEN, "«": OPEN, "„": OPEN, "”": CLOSE, "»": CLOSE, ":": COLON}
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»„:]|[.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
STEMS = (4, 5, 6, 7)
#: Symbols between the machines: threats, and what is negated or reported.
THREAT, NEGATED, REPORTED = 17, 18, 19
#: What the composed machine writes.
PLAIN, AIMED, DENIED, QUOTED, MENACE, MENACE_AIMED = range(1, 7)
FEATURES = ["best", "second", "clause", "next", "plain", "aimed", "negated", "reported", "menace", "menace_aimed"]
#: The model's weights before any label is seen, the constant first.
DEFAULT = np.array([-4.0, 3.0, 1.0, 1.0, 1.0, 1.0, 1.5, -0.5, -0.5, 3.0, 4.0])

Step = Callable[[int, int], tuple[int, int, float]]


def insult(q: int, s: int) -> tuple[int, int, float]:
    """State 1: something strengthening before; 2: an insult."""
    if s == INSULT:
        return 2, s, (1.0, 1.2, 1.1)[q]
    return (1 if s == BOOST else 0), s, 1.0


def threat(q: int, s: int) -> tuple[int, int, float]:
    """States 1 to 4: a subject, so many words ago; 5 to 8: you; 9 to 12: a frame; 13 to 16: you and a modal."""
    if s == END:
        return 0, s, 1.0
    if s in (HARM, DIE) and (q > 12 or q > 8 and s == HARM):
        return 0, THREAT, 1.2
    if s in (SELF, TARGET) and not q > 8:
        return 4, s, 1.0
    if s == YOU and not q > 8:
        return 8, s, 1.0
    if s == FRAME:
        return 12, s, 1.0
    if s == MODAL and q:
        return (16 if 4 < q <= 8 or q > 12 else 12), s, 1.0
    return (q - 1 if q % 4 != 1 and q else 0), OTHER if s in (HARM, DIE) else s, 1.0


def negation(q: int, s: int) -> tuple[int, int, float]:
    """States: how many words more a negation reaches."""
    if s == NEGATION:
        return 3, s, 1.0
    if s in (INSULT, THREAT) and q:
        return q - 1, NEGATED, 0.2
    return (0 if s == END else max(q - 1, 0)), s, 1.0


def reporting(q: int, s: int) -> tuple[int, int, float]:
    """Bit 0: behind a verb of report in its sentence; bit 1: between quotation marks."""
    if s in (QUOTE, OPEN, CLOSE):
        return (q ^ 2 if s == QUOTE else q | 2 if s == OPEN else q & 1), s, 1.0
    if s == END:
        return q & 2, s, 1.0
    if s == REPORT:
        return q | 1, s, 1.0
    return q, REPORTED if q and s in (INSULT, THREAT, NEGATED) else s, 0.3 if q and s in (INSULT, THREAT) else 1.0


def aiming(q: int, s: int) -> tuple[int, int, float]:
    """How far a target reaches yet (0 to 6), and a threat that waits for one (0 to 3); writes the outcome."""
    near, open_ = divmod(q, 4)
    if s == END:
        return 0, 0, 1.0
    target = s in (TARGET, YOU)
    then = 6 if target else max(near - 1, 0)
    out, w = {INSULT: (AIMED, 1.3) if near else (PLAIN, 1.0), THREAT: (MENACE_AIMED, 1.3) if near else (MENACE, 1.0), NEGATED: (DENIED, 1.0), REPORTED: (QUOTED, 1.0)}.get(s, (0, 1.0))
    if target and open_:
        return then * 4, MENACE_AIMED, 0.3
    return then * 4 + (3 if out == MENACE else max(open_ - 1, 0)), out, w


class Machine:
    """The composition of weighted transducers, each reading what the one before wrote; arcs are made when first taken."""

    def __init__(self, *steps: Step) -> None:
        self.steps = steps
        self.states: dict[tuple[int, ...], int] = {(0,) * len(steps): 0}
        self.names = [(0,) * len(steps)]
        self.arcs: dict[tuple[int, int], tuple[int, int, float]] = {}

    def step(self, q: int, s: int) -> tuple[int, int, float]:
        arc = self.arcs.get((q, s))
        if arc is None:
            then, w, out = [], 1.0, s
            for one, state in zip(self.steps, self.names[q], strict=True):
                to, out, by = one(state, out)
                then.append(to)
                w *= by
            k = self.states.setdefault(tuple(then), len(self.names))
            if k == len(self.names):
                self.names.append(tuple(then))
            arc = self.arcs[q, s] = k, out, w
        return arc


class Grammar:
    """The lexicon and the composed machine: features of a text."""

    def __init__(self, stems: dict[str, float]) -> None:
        self.stems = stems
        self.machine = Machine(insult, threat, negation, reporting, aiming)
        self.classes = {w: (k, 1.0) for k, ws in LISTS.items() for w in ws.split()} | {m: (k, 0.0) for m, k in MARKS.items()}
        self.seen: dict[str, tuple[int, float]] = {}
        self.plain: set[str] = set()

    def of(self, word: str) -> tuple[int, float]:
        """A lower-case word's or mark's class and weight."""
        hit = self.seen.get(word)
        if hit is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            hit = (END, 0.0) if word[0] in ".!?;\n" else self.classes.get(word.replace("’", "'"), (OTHER, 0.0))
            if hit[0] in (OTHER, INSULT):
                weight = max([self.stems.get(word + "$", 0.0), *(self.stems.get(word[:k], 0.0) for k in STEMS if len(word) >= k)])
                if weight or hit[0]:
                    hit = (INSULT, max(weight, hit[1]))
            self.seen[word] = hit
        return hit

    def any_match(self, words: set[str]) -> bool:
        """Whether one of the words can be matched; those that can't are remembered."""
        if len(self.plain) > 300_000:
            self.plain.clear()
        found = False
        for w in words - self.plain:
            if self.of(w)[0] in (INSULT, HARM, DIE):
                found = True
            else:
                self.plain.add(w)
        return found

    def clauses(self, low: str) -> list[tuple[dict[str, float], list[int]]]:
        """Of each clause with a match: the heaviest path of each matched word, and what was written."""
        q, found, wrote = 0, {}, []
        out = []
        for w in [*TOKEN.findall(low), "."]:
            k, weight = self.of(w)
            q, what, by = self.machine.step(q, k)
            if what:
                wrote.append(what)
                found[w] = max(found.get(w, 0.0), by * (weight or 1.0))
            if k == END:
                if wrote:
                    out.append((found, wrote))
                    found, wrote = {}, []
                if "\n" in w:  # a paragraph ends what was left open
                    q = 0
        return out

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        low = text.lower()
        if not self.any_match(set(WORD.findall(low))):
            return out
        parts = self.clauses(low)
        paths: dict[str, float] = {}
        out[2], out[3] = [*sorted((min(2.0, sum(found.values())) for found, _ in parts), reverse=True), 0.0, 0.0][:2]
        for found, wrote in parts:
            for w, weight in found.items():
                paths[w] = max(paths.get(w, 0.0), weight)
            for what in wrote:
                out[3 + what] += 1
        out[0], out[1] = [*sorted(paths.values(), reverse=True), 0.0, 0.0][:2]
        out[4:] = np.log1p(out[4:])
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """(text, toxic) of at most MOST_TOXIC and MOST_CLEAN labelled documents that aren't held out."""
    own = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
    own = own.groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    pick = lambda k, n: own.filter(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(n)
    few = pick(1, MOST_TOXIC).union(pick(0, MOST_CLEAN))  # 12,000 rows of 12 bytes at most
    return df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(few), "id").select("text", "toxic")


def stems_of(text: str) -> set[str]:
    """The words of a text, with $ behind, and the stems that they begin with."""
    words = set(WORD.findall(text.lower()))
    return {w + "$" for w in words} | {w[:k] for w in words for k in STEMS if len(w) >= k}


def learn_stems(rows: DataFrame) -> dict[str, float]:
    """Words (with $) and stems that toxic documents of (text, toxic) have and others hardly; weights from 0 to 1.

    The weight is the lower end of a 90 % interval (Wilson) of the share of toxic documents among those that have it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, pc.binary_length(whole.column(0)).fill_null(0).to_numpy(zero_copy_only=False), 1 << 20)):
            got: Counter = Counter()  # of a MB of text, so that it stays small
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got.update((f, x) for f in stems_of(t or ""))
            keys = list(got)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([got[k] for k in keys], pa.int64())], names=["f", "toxic", "n"])

    by = small_batches(rows).mapInArrow(count, "f string, toxic int, n long").groupBy("f").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("y"), F.sum("n").alias("n"))
    z, p = 1.645, F.col("y") / F.col("n")
    low = (p + z * z / (2 * F.col("n")) - z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    few = max(4, rows.filter("toxic = 1").count() // 100)  # else words of a few near copies would do
    top = by.filter(F.col("y") >= few).withColumn("w", low).filter(F.col("w") >= 0.5).orderBy(F.desc("w"), "f").limit(MOST_STEMS)
    return {r["f"]: float(r["w"]) for r in top.collect()}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic weights, the first for the constant, by Newton's steps; ridge pulls them toward DEFAULT."""
    x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    w, keep = DEFAULT.copy(), np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (p - y) + keep * (w - DEFAULT))
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[dict[str, float], np.ndarray]:
    """The learned stems and the model's weights."""
    rows = cut(sample(df, labels, doc_id, text, label))
    stems = learn_stems(rows)
    fields = [T.StructField("x", T.ArrayType(T.DoubleType()))]

    def make():
        g = Grammar(stems)
        return lambda texts: [pa.array([g.features(t).tolist() for t in texts], pa.list_(pa.float64()))]

    got = add_columns(rows, "text", make, fields).select("toxic", "x").collect()  # bounded by the sample
    y = np.array([r["toxic"] for r in got], float)
    if y.sum() < 5 or len(y) - y.sum() < 5:
        return stems, DEFAULT
    return stems, fit(np.array([r["x"] for r in got]), y)


def score(df: DataFrame, model: tuple[dict[str, float], np.ndarray], text: str = "text") -> DataFrame:
    """df with toxic_score double (0 to 1) and clauses array<int>: counts of what the grammar matched, as in FEATURES[4:]."""
    stems, w = model

    def make():
        g = Grammar(stems)

        def fn(texts: list[str]) -> list[pa.Array]:
            x = np.array([g.features(t) for t in texts]).reshape(len(texts), len(FEATURES))
            s = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            return [pa.array(s), pa.array(np.rint(np.expm1(x[:, 4:])).astype(np.int32).tolist(), pa.list_(pa.int32()))]

        return fn

    return add_columns(df, text, make, [T.StructField("toxic_score", T.DoubleType()), T.StructField("clauses", T.ArrayType(T.IntegerType()))])

"""Toxicity by a weighted finite-state grammar over clauses.

A lexical step turns the words of a clause into symbols: insults and threats from seed lists and from stems learned on labelled
texts, targets (you, they ...), negations, words of reporting, of intent and of stress.  A clause is read twice.  From right to
left, a small machine notes what is still to come: a target, or a reporting verb behind a comma.  From left to right five
weighted transducers follow each other, composed into one table: the insult transducer adds weight to insults under stress,
the threat transducer tells threats with intent from others, negation and reported speech mark what lies in their reach,
and the target transducer says which matches are directed at somebody.  Weights add up along a path; a clause gives the kinds
of match that it has with their weights.  A text's score is a logistic function of the greatest weight of each kind among its
clauses and of the sum of all, fitted on labelled texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, map_arrow, strings, tidy

# Seed words by symbol, in four languages.
WORDS = {
    "I": "idiot idiots moron morons loser losers clown clowns trash scum worthless pathetic disgusting stupid dumb imbecile cretin jerk filth vermin dumme dummkopf trottel abschaum wertlos ekelhaft imbécile crétin ordure minable dégoûtant idiota imbécil basura escoria patético asqueroso estúpido",
    "T": "kill murder hurt beat destroy strangle shoot stab hang töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir",
    "Y": "you your yours you're he she they them him her these those people everyone du dich dir ihr euch sie vous tu te toi ils elles tú usted ustedes ellos",
    "N": "not no never isn't aren't wasn't don't without nicht kein keine nie ne pas jamais no nunca ni sin",
    "R": "said says say called calls claimed wrote writes reported alleged according quoted sagte sagt nannte schrieb dit disait appelle dijo dice llamó escribió",
    "V": "so such very really total totally complete completely absolute absolutely utter utterly damn sehr total völlig très vraiment muy tan totalmente",
    "M": "will shall gonna going should must want werde wird sollte muss vais va dois voy debe",
}
SYMBOLS = "OITYNRMV,."  # O: any other word, .: end of a clause
#: What the reading from the right writes before a clause: whether a target, and a reporting verb behind a comma, is to come.
HEADS = ("<", "<Y", "<R", "<YR")
#: Kinds of match: insult or threat, and plain, directed at a target, with intent at a target, negated, reported.
KINDS = ["Ip", "Id", "In", "Ir", "Tp", "Td", "Ti", "Tn", "Tr"]
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:,\n]")
STEM_LENGTHS = (4, 5, 6)
#: How many words after them stress, intent and negation reach; negation reaches further to an insult than to a threat.
STRESS, INTENT, FAR, NEAR = 2, 3, 4, 2


@dataclass(frozen=True)
class Transducer:
    """next[state][symbol], and out[state][symbol]: symbols of the next transducer, or kinds of match, with what they weigh."""

    next: list[dict[str, int]]
    out: list[dict[str, tuple[tuple[str, float], ...]]]

    def __rshift__(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads, and weights add up."""
        n = len(other.next)
        nexts, outs = [], []
        for s in range(len(self.next)):
            for t in range(n):
                to, written = {}, {}
                for x, s2 in self.next[s].items():
                    t2, w = t, []
                    for y, weight in self.out[s][x]:
                        w += [(z, weight + more) for z, more in other.out[t2][y]]
                        t2 = other.next[t2][y]
                    to[x], written[x] = s2 * n + t2, tuple(w)
                nexts.append(to)
                outs.append(written)
        return Transducer(nexts, outs)

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        s, out = 0, []
        for x in symbols:
            out += self.out[s][x]
            s = self.next[s][x]
        return out


def transducer(states: int, alphabet: list[str], step) -> Transducer:
    """A transducer from a function (state, symbol) -> (next state, symbol written or None, weight)."""
    nexts, outs = [], []
    for s in range(states):
        made = {x: step(s, x) for x in alphabet}
        nexts.append({x: t for x, (t, _, _) in made.items()})
        outs.append({x: ((y, w),) if y is not None else () for x, (_, y, w) in made.items()})
    return Transducer(nexts, outs)


def insults() -> Transducer:
    """An insult weighs 1, and more up to STRESS words after a word of stress."""

    def step(s: int, x: str) -> tuple:
        if x == "V":
            return STRESS, "O", 0.0
        return (0 if x in ",." else max(0, s - 1)), x, (1.25 if s else 1.0) if x == "I" else 0.0

    return transducer(STRESS + 1, [*SYMBOLS, *HEADS], step)


def threats() -> Transducer:
    """A threat weighs 1; up to INTENT words after a word of intent it is meant: W, which weighs half as much again."""

    def step(s: int, x: str) -> tuple:
        if x == "M":
            return INTENT, "O", 0.0
        y = "W" if x == "T" and s else x
        # targets and negations stand between intent and verb without using up its reach
        return (0 if x in ",." else s if x in "YN" else max(0, s - 1)), y, {"T": 1.0, "W": 1.5}.get(y, 0.0)

    return transducer(INTENT + 1, [*"OITYNRM,.", *HEADS], step)


def negation() -> Transducer:
    """Insults up to FAR words and threats up to NEAR words after a negation are negated: In and Tn, of half the weight of others."""

    def step(s: int, x: str) -> tuple:
        if x in "ITW" and s > (0 if x == "I" else FAR - NEAR):
            return max(0, s - 1), ("I" if x == "I" else "T") + "n", -0.5
        return FAR if x == "N" else 0 if x in ",." else max(0, s - 1), x, 0.0

    return transducer(FAR + 1, [*"OITWYNR,.", *HEADS], step)


def reporting() -> Transducer:
    """Matches after a word of reporting, or before one that a comma parts from them, are reported: Ir and Tr.

    States: nothing yet, a reporting verb is to come behind a comma, a verb was there.
    """

    def step(s: int, x: str) -> tuple:
        if x in HEADS:
            return int("R" in x), x.replace("R", ""), 0.0
        if x == ".":
            return 0, x, 0.0
        if x == "R":
            return 2, "O", 0.0
        if s and x[0] in "ITW":
            return s, ("I" if x[0] == "I" else "T") + "r", -0.5
        return (0 if s == 1 and x == "," else s), x, 0.0

    return transducer(3, [*"OITWYNR,.", "In", "Tn", *HEADS], step)


def targeting() -> Transducer:
    """Matches of a clause with a target, before or after them, are directed: Id and Td, Ti with intent; else plain: Ip and Tp."""

    def step(s: int, x: str) -> tuple:
        if x in HEADS:
            return int("Y" in x), None, 0.0
        if x == ".":
            return 0, None, 0.0
        if len(x) == 2:
            return s, x, 0.0
        if x in "ITW":
            return s, {"I": "Ip", "T": "Tp", "W": "Tp"}[x] if not s else {"I": "Id", "T": "Td", "W": "Ti"}[x], 0.5 * s
        return int(s or x == "Y"), None, 0.0

    return transducer(2, [*"OITWYN,.", "In", "Tn", "Ir", "Tr", "<", "<Y"], step)


def ahead() -> Transducer:
    """Read from right to left: writes, at the clause's beginning, one of HEADS.

    States: target seen (1), reporting verb seen (2), and a comma before that verb (4).
    """

    def step(s: int, x: str) -> tuple:
        if x == ".":
            return 0, HEADS[(s & 1) + 2 * bool(s & 4)], 0.0
        return s | {"Y": 1, "R": 2}.get(x, 0) | (4 if x == "," and s & 2 else 0), None, 0.0

    return transducer(8, [*SYMBOLS], step)


@dataclass(frozen=True)
class Lexicon:
    """Words by symbol, and stems: beginnings of words that count as insults."""

    words: tuple[tuple[str, str], ...]
    stems: tuple[str, ...] = ()


SEEDS = Lexicon(tuple((w, s) for s, ws in WORDS.items() for w in ws.split()))


SEED_WORDS = frozenset(w for w, _ in SEEDS.words)


class Grammar:
    """The lexicon's automaton and the composed transducers."""

    def __init__(self, lexicon: Lexicon):
        self.symbol, self.stems = dict(lexicon.words), frozenset(lexicon.stems)
        self.hits = ahocorasick.Automaton()
        for w, s in lexicon.words:
            if s in "IT":
                self.hits.add_word(w, (len(w), True))
        for w in lexicon.stems:
            self.hits.add_word(w, (len(w), False))
        self.hits.make_automaton()
        self.machine = insults() >> threats() >> negation() >> reporting() >> targeting()
        self.ahead = ahead()

    def symbol_of(self, word: str) -> str:
        if (s := self.symbol.get(word)) is not None:
            return s
        return "I" if any(word[:k] in self.stems for k in STEM_LENGTHS if len(word) > k) else "O"

    def found(self, low: str) -> bool:
        """Whether a text in lower case has a word that can begin a match."""
        for end, (size, whole) in self.hits.iter(low):
            start = end - size + 1
            if not (start and low[start - 1].isalnum()) and not (whole and end + 1 < len(low) and low[end + 1].isalnum()):
                return True
        return False

    def clause(self, symbols: list[str]) -> list[tuple[str, float]]:
        """Kinds of match of a clause and what they weigh."""
        head = self.ahead.run([*reversed(symbols), "."])[0][0]
        return self.machine.run([head, *symbols, "."])

    def matches(self, text: str) -> Counter:
        """The greatest weight of each kind of match among the clauses of a whole text, and the sum of all under "all"."""
        out: Counter = Counter()
        low = text.lower()
        if not self.found(low):
            return out
        clause: list[str] = []
        for w in [*TOKEN.findall(low), "."]:
            if w in ".!?;:\n":
                if "I" in clause or "T" in clause:
                    for kind, weight in self.clause(clause):
                        out[kind] = max(out[kind], weight)
                        out["all"] += weight
                clause = []
            else:
                clause.append("," if w == "," else self.symbol_of(w))
        return out


@cache
def grammar(lexicon: Lexicon) -> Grammar:
    """One grammar per worker process and lexicon."""
    return Grammar(lexicon)


def vector(found: Counter) -> list[float]:
    """A text's greatest weight of each kind of match, and how much they weigh in all."""
    return [*(float(found[k]) for k in KINDS), math.log1p(found["all"])]


@dataclass(frozen=True)
class Model:
    """A lexicon and the weights of the kinds of match, the bias last."""

    lexicon: Lexicon = SEEDS
    weights: tuple[float, ...] = (3.0, 3.0, 0.5, 0.5, 1.0, 2.0, 3.0, 0.0, 0.0, 1.0, -3.0)

    def score(self, text: str) -> float:
        z = sum(w * x for w, x in zip(self.weights, [*vector(grammar(self.lexicon).matches(text)), 1.0]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms(words: list[str]) -> set[str]:
    """Distinct words that are no seeds, and their beginnings marked by an asterisk."""
    own = {w for w in words if len(w) > 3} - SEED_WORDS
    return own | {w[:k] + "*" for w in own for k in STEM_LENGTHS if len(w) > k}


def clauses(text: str) -> Iterator[list[str]]:
    """The words of each clause of a text, in lower case."""
    words: list[str] = []
    for w in [*TOKEN.findall(text.lower()), "."]:
        if w in ".!?;:\n":
            if words:
                yield words
            words = []
        elif w != ",":
            words.append(w)


def learned(counts: list[tuple[str, int, int, int, int]], toxic: int, clean: int, odds: float = 20.0) -> Lexicon:
    """Seeds and the words and stems that mark toxic texts, from rows of (term, toxic texts, clean texts, distinct words, distinct
    clauses of toxic texts that have it).

    A term is taken if it is ``odds`` times as frequent in toxic texts as in clean ones, and in four different clauses at
    least: near copies of a text share theirs.  A stem asks for four toxic texts, one in sixty and four distinct words, a
    word for six toxic texts and one in fifty.  Of stems that begin alike, the shortest stands for all.
    """

    def marks(a: int, b: int, c: int) -> bool:
        return c >= 4 and (a + 0.5) / (toxic + 1) >= odds * (b + 0.5) / (clean + 1)

    known = dict(SEEDS.words)
    stems: set[str] = set()
    for t, a, b, n, c in sorted(counts, key=lambda r: (len(r[0]), r[0])):
        if t.endswith("*") and n >= 4 and a >= max(4, toxic / 60) and marks(a, b, c) and not any(t[:k] in stems for k in STEM_LENGTHS if k < len(t) - 1):
            stems.add(t[:-1])
    words = [t for t, a, b, _, c in counts if not t.endswith("*") and a >= max(6, toxic / 50) and marks(a, b, c) and t not in known and not any(t[:k] in stems for k in STEM_LENGTHS)]
    return Lexicon(SEEDS.words + tuple((w, "I") for w in sorted(words)), tuple(sorted(stems)))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; x has a last column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn a model from labelled texts: at most ``most`` of them, those of the smallest hashes of their ids, read whole.

    Rows without an id or label are left out; several labels of an id count as their largest, several texts of an id are
    texts of their own, and null texts are empty ones.  Without any label of either kind the seed model is returned.  The
    model is the same on every run.
    """
    spark = docs.sparkSession
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    own = docs.select(docs[id_col].alias("id"))
    sample = known.join(own.distinct(), "id").orderBy(F.xxhash64("id"), "id").limit(most).collect()  # bounded by most
    toxic = sum(r["y"] for r in sample)
    if not toxic or toxic == len(sample):
        return Model()
    chosen = spark.createDataFrame([(r["id"], r["y"]) for r in sample], known.schema)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id").repartition(8, "id")

    texts = cut(texts)
    varied = texts.select("text", "y").dropDuplicates()  # equal texts count once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, where = (Counter(), Counter()), {}
        for b in batches:
            for t, y in zip(strings(b, "text"), b.column(1).to_pylist()):
                own: set[str] = set()
                for words in clauses(t):
                    new = terms(words)
                    own |= new
                    if y:
                        h = xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) >> 1
                        for x in new:
                            where.setdefault(x, set()).add(h)
                each[y].update(own)
        # terms that no toxic text has can't be learned, so only their counts matter where some other task has them
        found = list(each[1].keys() | each[0].keys())
        for i in range(0, len(found), 20_000):
            part = found[i : i + 20_000]
            yield pa.record_batch([pa.array(part), pa.array([each[1][t] for t in part], pa.int64()), pa.array([each[0][t] for t in part], pa.int64()), pa.array([sorted(where.get(t, ())) for t in part], pa.list_(pa.int64()))], ["term", "a", "b", "clauses"])

    bounded(spark)
    counted = varied.mapInArrow(tidy(count), "term string, a long, b long, clauses array<long>")
    counts = cut(counted.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.size(F.array_distinct(F.flatten(F.collect_list("clauses")))).alias("clauses")).filter("a > 0 and a > b"))
    stem = F.explode(F.array(*(F.when(F.length("term") > k, F.concat(F.substring("term", 1, k), F.lit("*"))) for k in STEM_LENGTHS)))
    spread = counts.filter(~F.col("term").endswith("*")).select(stem.alias("term")).dropna().groupBy("term").agg(F.count("*").alias("n"))
    found = counts.filter("a >= 4 and clauses >= 4").join(spread, "term", "left").select("term", "a", "b", F.coalesce("n", F.lit(1)).alias("n"), "clauses").filter("term not like '%*' or n >= 4")
    kinds = {r["y"]: r["count"] for r in varied.groupBy("y").count().collect()}
    lexicon = learned([tuple(r) for r in found.collect()], kinds.get(1, 0), kinds.get(0, 0))

    def features(b: pa.RecordBatch) -> pa.RecordBatch:
        g = grammar(lexicon)
        return pa.record_batch([b.column(1), pa.array([vector(g.matches(t)) for t in strings(b, "text")], pa.list_(pa.float64()))], ["y", "x"])

    rows = map_arrow(texts.select("text", "y"), features, "y int, x array<double>").collect()  # as many as the sample
    rows = sorted((r["y"], *r["x"]) for r in rows)  # so that sums, and with them the weights, are the same on every run
    x = np.array([[*r[1:], 1.0] for r in rows])
    return Model(lexicon, tuple(round(w, 9) for w in fitted(x, np.array([r[0] for r in rows], float)).tolist()))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, from 0 to 1; null and empty texts get the score of a text without any match."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column(0), pa.array([model.score(t) for t in strings(b, "text")], pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is under ``least``, with all columns as they are.

    Null and empty texts have no match and stay, repeated rows are judged alike, and an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t or "") < least for t in b.column(at).to_pylist()], pa.bool_()))

    bounded(docs.sparkSession)
    return docs.mapInArrow(tidy(run), docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether a row's label may not be learned from: crc32 of the id as text leaves no rest."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0

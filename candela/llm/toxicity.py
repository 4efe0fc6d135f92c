"""Toxicity by a weighted finite-state pattern grammar.

A letter transducer maps words to classes: insults and threats with weights, targets, negators and
verbs of reported speech. Its insults are stems and whole words that the labelled texts give; the
closed classes are fixed lists. Transducers over these classes, one each for insults, threats, targets, negation (a scope
of a few words) and reported speech (to the end of the clause), are composed into one machine that
runs over a clause. As a target may follow its match, a second machine reads the clause from its end, and a
table gives the output of each pair of states (a bimachine). Each match leaves with the pattern that it stands in, so
"he said they are no fools" and "you fool" count in different patterns. A logistic model, fitted
on the labels and held towards prior weights in which negated and reported matches count less, turns
the matched patterns of all clauses into a score.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .quality import labelled_sample

#: The most labelled rows that the grammar is fitted on.
SAMPLE = 20_000
SHORTEST, LONGEST = 4, 9
SCOPE = 3
#: A key tells if its log odds and its likelihood ratio against chance are so large.
LEAST_ODDS, LEAST_EVIDENCE = 2.5, 20.0
# fixed values: closed word classes in the languages served
TARGET = "you your yours yourself he she they him her them their this these those people du dich dir dein deine ihr euch sie er tu toi te vous votre il elle ils elles tú ti usted ustedes él ella ellos ellas".split()
NEGATION = "not no never none neither nor without isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans ni nunca jamás ningún ninguna sin".split()
REPORT = "said says say saying wrote writes claimed claims quoted quotes called reported told according sagte sagt schrieb behauptete laut zitierte dit disait écrit selon affirme raconte dijo dice escribió según afirmó citó".split()
THREAT = "kill murder hurt destroy shoot stab strangle töten umbringen erschießen verletzen tuer assassiner frapper détruire matar asesinar golpear destruir".split()
CLAUSE = re.compile(r"[.;:!?\n]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
OTHER, INSULT, THREATEN, TARGETED, NEGATED, REPORTED = range(6)
KINDS = (INSULT, THREATEN)
PATTERNS = {x: k for k, x in enumerate(product(KINDS, (False, True), (False, True), (False, True)))}  # kind, targeted, negated, reported


class Transducer(NamedTuple):
    """States are integers from 0, where it starts; ``step`` gives the next state by state and class (-1: any other
    class; none: it stays); a token is marked if reading it leads into a state of ``out``."""

    step: dict[tuple[int, int], int]
    out: frozenset[int]

    def move(self, state: int, token: int) -> int:
        return self.step.get((state, token), self.step.get((state, -1), state))


def _each(kind: int) -> Transducer:
    """Marks the tokens of class ``kind``."""
    return Transducer({(s, t): int(t == kind) for s in (0, 1) for t in range(6)}, frozenset([1]))


def _scope(opens: int, length: int) -> Transducer:
    """Marks the ``length`` tokens after one of class ``opens``."""
    steps = {(s, -1): max(0, s - 1) for s in range(length + 2)} | {(s, opens): length + 1 for s in range(length + 2)}
    return Transducer(steps, frozenset(range(1, length + 1)))


def _rest(opens: int) -> Transducer:
    """Marks all tokens from one of class ``opens`` on."""
    return Transducer({(0, opens): 1}, frozenset([1]))


class Composed(NamedTuple):
    moves: list[list[int]]  # by state and class
    marks: list[tuple[bool, ...]]  # by state, whether each transducer marks the token that led there


def composed(*machines: Transducer) -> Composed:
    """The product of transducers, with the states that can be reached; 0 is the first."""
    numbers, open_, moves = {(0,) * len(machines): 0}, [(0,) * len(machines)], []
    for state in open_:
        row = []
        for token in range(6):
            to = tuple(m.move(s, token) for s, m in zip(state, machines))
            if to not in numbers:
                numbers[to] = len(open_)
                open_.append(to)
            row.append(numbers[to])
        moves.append(row)
    return Composed(moves, [tuple(s in m.out for s, m in zip(state, machines)) for state in open_])


AHEAD = composed(_each(INSULT), _each(THREATEN), _rest(TARGETED), _scope(NEGATED, SCOPE + 1), _rest(REPORTED))
BEHIND = composed(_rest(TARGETED))  # reads from the end


def _outputs() -> list[list[int | None]]:
    """The pattern that a token leaves with, by the state of either machine."""
    return [[PATTERNS[INSULT if insult else THREATEN, before or after, negated, reported] if insult or threat else None for (after,) in BEHIND.marks] for insult, threat, before, negated, reported in AHEAD.marks]


OUTPUT = _outputs()


class Grammar(NamedTuple):
    stems: dict[str, float]  # any word that begins so
    words: dict[str, float]
    weights: np.ndarray


class Machine:
    """The letter transducer of a grammar ahead of the composed machines."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.words = {w: (TARGETED, 0.0) for w in TARGET} | {w: (NEGATED, 0.0) for w in NEGATION} | {w: (REPORTED, 0.0) for w in REPORT}
        self.words |= {w: (THREATEN, 3.0) for w in THREAT} | {w: (INSULT, x) for w, x in grammar.words.items()}
        self.lengths = sorted({len(s) for s in grammar.stems})
        self.finder = ahocorasick.Automaton()
        for w in {*grammar.stems, *grammar.words, *THREAT}:
            self.finder.add_word(w, len(w))
        if len(self.finder):
            self.finder.make_automaton()

    def token(self, word: str) -> tuple[int, float]:
        if found := self.words.get(word):
            return found
        for n in self.lengths:
            if (x := self.grammar.stems.get(word[:n])) is not None:
                return INSULT, x
        return OTHER, 0.0

    def clause(self, text: str) -> list[tuple[int, float]]:
        """(pattern, weight) of the matches in a clause."""
        tokens = [self.token(m[0]) for m in WORD.finditer(text)]
        behind, state = [], 0
        for kind, _ in reversed(tokens):
            state = BEHIND.moves[state][kind]
            behind.append(state)
        out, state = [], 0
        for (kind, weight), after in zip(tokens, reversed(behind)):
            state = AHEAD.moves[state][kind]
            if (pattern := OUTPUT[state][after]) is not None:
                out.append((pattern, weight))
        return out

    def matches(self, text: str | None) -> list[tuple[int, float]]:
        """Matches of all clauses of a whole text; only clauses in which a stem occurs are run."""
        if not text or not len(self.finder):
            return []
        low, done, out = text.lower(), 0, []
        for end, length in self.finder.iter(low):
            begin = end - length + 1
            if begin < done or begin and low[begin - 1].isalpha():
                continue
            first = max(done, *(low.rfind(mark, done, begin) + 1 for mark in ".;:!?\n"))
            after = CLAUSE.search(low, end + 1)
            done = after.end() if after else len(low)
            out += self.clause(low[first:done])
        return out

    def features(self, text: str | None) -> np.ndarray:
        """By pattern the summed weight, damped; then all weight, its largest, and weight by length."""
        found, sums = self.matches(text), np.zeros(len(PATTERNS))
        for pattern, weight in found:
            sums[pattern] += weight
        total = sums.sum()
        return np.concatenate((np.log1p(sums), [np.log1p(total), max((w for _, w in found), default=0.0) / 5, np.log1p(2000 * total / (len(text or "") + 200)), min(len(found), 3)]))


EXTRA = 4


def prior_weights() -> np.ndarray:
    """Weights before any label is seen: a match counts, less if negated or reported."""
    own = [(0.8 if targeted else 0.6) * (0.3 if negated else 1) * (0.3 if reported else 1) for _, targeted, negated, reported in PATTERNS]
    return np.array([*own, 0.3, 0.3, 0.2, 0.3, -3.0])


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 2.0) -> np.ndarray:
    """Ridge logistic regression towards the prior, by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    prior = prior_weights()
    weights = prior.copy()
    if not len(y) or y.min() == y.max():
        return weights
    strength = np.full(len(prior), penalty)
    strength[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - y) + strength * (weights - prior)
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(strength), gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by label in which a word (closed by a blank) or the beginning of one occurs."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    size = [0, 0]

    def flush():
        keys = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["key", "t", "n"])
        counts[0].clear(), counts[1].clear()
        return out

    for batch in batches:
        for text, y in zip(C.texts(batch, "text"), batch.column("y").to_pylist()):
            words = {w for w in WORD.findall((text or "").lower()) if len(w) >= SHORTEST}
            keys = {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)}
            counts[y > 0].update(keys)
            counts[y > 0].update([w + " " for w in words])
            size[y > 0] += 1
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield flush()
    yield flush()
    yield pa.RecordBatch.from_arrays([pa.array(["  "]), pa.array([size[1]], pa.int64()), pa.array([size[0]], pa.int64())], names=["key", "t", "n"])


def lexicon(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Stems and whole words from (key, toxic texts, clean texts): the shortest beginnings that tell, each
    made as long as it can be without losing a text."""
    tells = {}
    for key, t, n in rows:
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1))
        tells[key] = (t, odds)
    ordered, stems, words = sorted(tells), {}, {}

    def beginning(text: str) -> list[str]:
        return ordered[bisect_left(ordered, text) : bisect_left(ordered, text + chr(0x10FFFF))]

    covered: set[str] = set()  # keys that begin with a stem
    for key in sorted(tells, key=lambda k: (len(k.rstrip()), k)):
        if any(key[:k] in stems for k in range(SHORTEST, len(key))) or not key.endswith(" ") and key in covered:
            continue
        best = key
        if not key.endswith(" "):
            best = max((k for k in beginning(key) if tells[k][0] == tells[key][0]), key=lambda k: (len(k.rstrip()), k.endswith(" ")))
        if best.endswith(" "):
            words[best.rstrip()] = float(tells[best][1])
        else:
            stems[best] = float(tells[best][1])
            covered.update(beginning(best))
    return stems, words


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Learn lexicon and weights from at most ``sample`` labelled ids outside the held-out fifth. Both
    steps count on the executors; the driver gets the telling keys and the pattern
    features of the sample. Without labels of both kinds only the fixed lists and the prior are used."""
    sampled = C.stored(labelled_sample(documents, labels, "toxic", sample))
    counts = C.stored(sampled.select("text", "y").mapInArrow(_prefix_counts, "key string, t bigint, n bigint").groupBy("key").agg(F.sum("t").alias("t"), F.sum("n").alias("n")))
    whole = counts.where("key = '  '").first()
    toxic, clean = (whole["t"], whole["n"]) if whole else (0, 0)
    stems, words = {}, {}
    if toxic and clean:
        odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (clean + 1))
        share, met = toxic / (toxic + clean), F.col("t") + F.col("n")
        evidence = 2 * (F.col("t") * F.log(F.col("t") / (met * share)) + F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / (met * (1 - share)))).otherwise(0.0))
        rows = counts.where((F.col("key") != "  ") & (F.col("t") >= 3) & (odds >= LEAST_ODDS) & (evidence >= LEAST_EVIDENCE)).orderBy("key").collect()
        stems, words = lexicon([tuple(r) for r in rows], toxic, clean)
    grammar = Grammar(stems, words, prior_weights())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(grammar)
        for batch in batches:
            x = [machine.features(t) for t in C.texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = sampled.select("text", "y").mapInArrow(run, "y int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(PATTERNS) + EXTRA)
    y = (got.column("y").to_numpy() > 0).astype(float)
    order = np.lexsort((*x.T, y))
    return grammar._replace(weights=fit_weights(x[order], y[order]))


def score(documents: DataFrame, grammar: Grammar, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``documents`` with score and predicted (1 from ``threshold`` on), from the clauses of the whole
    text. Null and empty texts match nothing; columns of these names are replaced."""
    body = C.free_name(documents.columns, "body")
    rest = [c for c in documents.columns if c not in ("score", "predicted")]
    source = C.small_batches(documents).select(*rest, F.col(text_col).alias(body))
    keep = documents.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(keep.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                x = np.array([machine.features(t) for t in C.texts(part, body)]).reshape(-1, len(PATTERNS) + EXTRA)
                weights = keep.value.weights
                p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                arrays = [part.column(c) for c in rest] + [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "score", "predicted"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name != body)
    return source.mapInArrow(run, f"{schema}score double, predicted int")

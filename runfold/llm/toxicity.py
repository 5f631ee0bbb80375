"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words map to a few symbols: insult, threat, target, negation, report, any other word. Five
small transducers read a clause's symbols, each with its own states: how far an insult is established, a threat, a target beside either, a
negation before either, reported speech. They are composed into one table of the states that
can be reached, and a clause's last state says what the combination is:

* ``directed``: an insult and a target, neither negated nor reported;
* ``menace``: a threat and a target, likewise;
* ``bare``: an insult with no target (two for several in the clause); ``violence``: such a threat;
* ``disclaimed``: an insult or threat that is negated or reported, which counts for nothing else.

A document's score is the logistic of its clauses' weighted features. One directed insult or menace
makes it toxic, one bare word or disclaimed clause does not: only bare words that repeat do. The labelled sample moves the weights
inside these bounds (`bounded`).

The lexicon is a short fixed list and, where labelled rows are given, words and stems that
cover their toxic documents; a learned word counts as the insult that it is, so in its clause only.
Both come from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.llm import common, sample
from runfold.session import ship

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
#: Fixed word lists.
WORDS = {
    INSULT: "idiot idiots moron morons stupid scum loser losers trash clown clowns pathetic worthless disgusting imbecile vermin filth dumb ugly dummkopf abschaum trottel wertlos ekelhaft connard crétin minable ordure dégoûtant estúpido basura imbécil asqueroso",
    THREAT: "kill hurt destroy smash burn stab töten vernichten tuer détruire matar destruir",
    TARGET: "you your yours he she they them him her these those people du dich euch ihr tu toi vous ton votre tú usted ustedes ellos",
    NEGATION: "not no never without isn't aren't nobody nicht kein keine nie pas jamais aucun nunca ningún",
    REPORT: "said says called calls wrote quoted claimed told alleged sagte nannte dit disait dijo llamó",
}
FEATURES = ("directed", "menace", "bare", "violence", "disclaimed")
#: Prior weights of the features, and of no match.
PRIOR = np.array([6.5, 6.5, 3.2, 1.5, 0.5])
PRIOR_SHIFT = -4.8
#: Scores that one bare word, threat or disclaimed clause stays below, and that two bare words, or one directed insult or menace, reach.
LONE, TWICE, AIMED = 0.2, 0.6, 0.8
#: Bound of the labelled sample: documents a class. Stems of 4 to 8 letters may be learned.
PER_CLASS = 2500
STEMS = range(4, 9)
COST = 20
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: What French elides before a word.
ELIDED = re.compile(r"(?:[cdjlmnst]|qu)['’](?=[^\W\d_])")
CLAUSE_END = re.compile(r"[.!?;:\n]")

# Transducers: state -> symbol -> next state (a symbol not named stays).
INSULTS = {0: {INSULT: 1}, 1: {INSULT: 2}, 2: {}}
THREATS = {0: {THREAT: 1}, 1: {}}
# a target and an insult or a threat, in either order
TARGETS = {0: {TARGET: 1, INSULT: 2, THREAT: 2}, 1: {INSULT: 3, THREAT: 3}, 2: {TARGET: 3}, 3: {}}
# a negation at most three words before the insult or threat, where no other stands unnegated
NEGATIONS = {0: {NEGATION: 1, INSULT: 5, THREAT: 5}, **{n: {NEGATION: 1, INSULT: 4, THREAT: 4, OTHER: n + 1 if n < 3 else 0, TARGET: n + 1 if n < 3 else 0, REPORT: n + 1 if n < 3 else 0} for n in (1, 2, 3)}, 4: {}, 5: {}}
# a verb of saying before the insult or threat
REPORTS = {0: {REPORT: 1, INSULT: 2, THREAT: 2}, 1: {INSULT: 3, THREAT: 3}, 2: {}, 3: {}}


def meaning(insults: int, threat: int, target: int, negation: int, report: int) -> dict[str, float]:
    """The features of a clause from the last states of the five transducers."""
    if not (insults or threat):
        return {}
    if negation == 4 or report == 3:
        return {"disclaimed": 1.0}
    if target == 3:
        return {name: 1.0 for name, on in (("directed", insults), ("menace", threat)) if on}
    return {name: float(n) for name, n in (("bare", insults), ("violence", threat)) if n}


def compose(*machines) -> tuple[np.ndarray, np.ndarray]:
    """The product of the transducers: (next state by state and symbol, features by state), state 0 the start."""
    start = tuple(0 for _ in machines)
    number, queue, table = {start: 0}, deque([start]), []
    while queue:
        state = queue.popleft()
        row = []
        for symbol in range(6):
            after = tuple(arcs[s].get(symbol, s) for arcs, s in zip(machines, state, strict=True))
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            row.append(number[after])
        table.append(row)
    last = np.zeros((len(number), len(FEATURES)))
    for state, n in number.items():
        for name, value in meaning(*state).items():
            last[n, FEATURES.index(name)] = value
    return np.array(table), last


TABLE, LAST = compose(INSULTS, THREATS, TARGETS, NEGATIONS, REPORTS)


@dataclass
class Grammar:
    """words: symbol by word; stems: beginnings of insults; weights and shift of the logistic."""

    words: dict[str, int] = field(default_factory=lambda: {w: s for s, ws in WORDS.items() for w in ws.split()})
    stems: tuple[str, ...] = ()
    weights: np.ndarray = field(default_factory=PRIOR.copy)
    shift: float = PRIOR_SHIFT

    def compile(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, grammar: Grammar):
        import ahocorasick

        self.grammar, self.stems = grammar, set(grammar.stems)
        self.sizes = sorted({len(s) for s in self.stems})
        self.find = ahocorasick.Automaton()
        for w in {*(w for w, s in grammar.words.items() if s in (INSULT, THREAT)), *grammar.stems}:
            self.find.add_word(w, len(w))
        self.find.make_automaton()

    def symbol(self, word: str) -> int:
        got = self.grammar.words.get(word)
        if got is None:
            got = INSULT if any(word[:n] in self.stems for n in self.sizes) else OTHER
            if got == OTHER and (elided := ELIDED.match(word)):
                got = self.symbol(word[elided.end() :])
        return got

    def features(self, text: str) -> np.ndarray:
        """The sum of the matched clauses' features; clauses end at . ! ? ; : and line ends."""
        low = text.lower()
        total, done = np.zeros(len(FEATURES)), 0
        for end, size in self.find.iter(low):
            at = end - size + 1
            if at < done or (at and low[at - 1].isalpha() and low[at].isalpha()):
                continue  # in a clause that is done, or inside a word
            begin = max(done, 1 + max(low.rfind(c, done, at) for c in ".!?;:\n"))
            found = CLAUSE_END.search(low, at)
            done = found.end() if found else len(low)
            state = 0
            for m in LETTERS.finditer(low, begin, done):
                state = TABLE[state, self.symbol(m[0])]
            total += LAST[state]
        return total

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(squash(self.features(text)) @ self.grammar.weights + self.grammar.shift, -30, 30))))


def squash(x: np.ndarray) -> np.ndarray:
    """Counts of clauses grow the evidence slowly: log2(1 + n)."""
    return np.log2(1 + x)


def candidates(text: str) -> set[str]:
    words = {w for w in LETTERS.findall(text.lower()) if len(w) >= STEMS[0]}
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}


def learn_lexicon(rows: DataFrame, least: int = 4, most: int = 2000) -> tuple[list[str], list[str]]:
    """(words, stems) that mark the toxic documents of a bounded sample (label, text).

    Spark counts in how many documents of each class a word or stem is; those which are nearly
    always toxic are candidates, at most ``most``, the most frequent. Of them the greedy choice
    takes the one that marks most toxic documents not yet marked three times; a clean one costs ``COST``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(common.texts(batch), batch.column("label").to_pylist(), strict=True):
                seen[label].update(candidates(text))
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "clean": pa.array([seen[0][n] for n in names], pa.int64()), "toxic": pa.array([seen[1][n] for n in names], pa.int64())})

    sums = rows.select("label", "text").mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sure = sums.where(F.col("toxic") >= F.lit(least)).where(F.col("clean") * 25 <= F.col("toxic")).orderBy(F.col("toxic").desc(), "feature").limit(most)
    wanted = {r.feature: r.clean for r in sure.select("feature", "clean").collect()}

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"features": pa.array([sorted(candidates(t) & wanted.keys()) for t in common.texts(batch)], pa.list_(pa.string()))})

    marked = [set(r.features) for r in rows.where("label = 1").select("text").mapInArrow(mark, "features array<string>").collect()]
    of: dict[str, list[int]] = {}
    for n, names in enumerate(marked):
        for name in names:
            of.setdefault(name, []).append(n)
    chosen, need = [], np.full(len(marked), 3)
    while of:
        gain = {name: int((need[docs] > 0).sum()) for name, docs in of.items()}
        best = max(gain, key=lambda k: (gain[k] - COST * wanted[k], len(k), k))
        if gain[best] < least or gain[best] - COST * wanted[best] <= 0:
            break
        chosen.append(best)
        need[of.pop(best)] -= 1
        of = {k: v for k, v in of.items() if gain[k] >= least and k != best}
    return [c for c in chosen if c[-1] != "*"], [c[:-1] for c in chosen if c[-1] == "*"]


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 2.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Logistic weights by Newton steps, held near the prior by ``pull``."""
    x = np.column_stack((x, np.ones(len(x))))
    prior = np.append(PRIOR, PRIOR_SHIFT)
    w, hold = prior.copy(), np.full(len(prior), pull)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(hold), x.T @ (p - y) + hold * (w - prior))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def bounded(weights: np.ndarray, shift: float) -> tuple[np.ndarray, float]:
    """Weights moved as little as the grammar's own rules ask: see ``LONE``, ``TWICE`` and ``AIMED``."""
    w = dict(zip(FEATURES, map(float, weights), strict=True))
    one, two = squash(np.array([1.0, 2.0]))
    w["bare"] = max(w["bare"], (logit(TWICE) - logit(LONE)) / (two - one))
    shift = min(shift, logit(LONE) - w["bare"] * one)
    for name in ("violence", "disclaimed"):
        w[name] = min(w[name], (logit(LONE) - shift) / one)
    w["bare"] = max(w["bare"], (logit(TWICE) - shift) / two)
    shift = min(shift, logit(LONE) - w["bare"] * one)
    for name in ("directed", "menace"):
        w[name] = max(w[name], (logit(AIMED) - shift) / one)
    return np.array([w[name] for name in FEATURES]), shift


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> Grammar:
    """The grammar with lexicon and weights from at most ``per_class`` labelled documents of each class."""
    rows = sample.labelled(docs, labels, "toxic", learn, per_class)
    words, stems = learn_lexicon(rows)
    grammar = Grammar()
    grammar.words.update({w: INSULT for w in words if w not in grammar.words})
    grammar.stems = tuple(stems)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = grammar.compile()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([squash(matcher.features(t)).tolist() for t in common.texts(batch)], pa.list_(pa.float64())), "label": batch.column("label")})

    got = rows.select("label", "text").mapInArrow(measure, "x array<double>, label int").collect()  # 2 * per_class rows of few numbers
    if len({r.label for r in got}) == 2:
        grammar.weights, grammar.shift = bounded(*fit_weights(np.array([r.x for r in got]), np.array([r.label for r in got], float)))
    return grammar


def scorer(grammar: Grammar):
    """A column function: the score of a text; null and empty texts have no matched clause."""

    @F.pandas_udf("double")
    def score_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = grammar.compile()
        for texts in batches:
            yield pd.Series([matcher.score(t or "") for t in texts], dtype="float64")

    return score_text


def flag(docs: DataFrame, grammar: Grammar, out: str) -> DataFrame:
    """All rows and columns of ``docs`` with the score of ``text`` added as ``out``; nothing is shuffled."""
    ship(docs.sparkSession)
    return docs.withColumn(out, scorer(grammar)(F.col("text").cast("string")))

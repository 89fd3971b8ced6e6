"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer reads words as symbols: insults of three strengths, threats, targets, negations, reported
speech, other. Pattern transducers read symbols and give weights:

* the insult pattern: an insult after a target in reach ("you ... idiot") is a full match; alone it is a weak
  match, made full when a target follows in reach ("idiot that you are");
* the threat pattern: a threat and a target in reach, in either order; without a target it is no match;
* negation, which scales what matches soon after it, and reported speech, which scales all that follows in its
  clause.

The patterns are composed into one deterministic machine whose arcs carry the weights; a clause is scored by
its path through that machine and in no other way, so a word weighs nothing by itself. A document's evidence
is the weight of its matched clauses, the strongest first and the others with falling shares; a logistic curve
fitted to the labels turns it into a score.

The insults and their strengths are learned from labelled rows outside fold 0: words and word beginnings that
occur in more independent toxic texts than chance allows (near copies count once), then those that explain
toxic texts not yet reached. The fit uses at most about ``sample`` labelled documents; everything that they
teach is kept. The weights of the patterns' arcs are learned from the same rows: those typed in are where the fit
begins and what it is drawn to, so they move as far as the labels say. ``context_free`` is the machine without any
context, for comparison.

Defined results: a null or empty text has no evidence and gets the curve's value at zero, which is below
one half; without labels there is only the fixed lexicon and a fixed curve; a null id is never learned
from; a document labelled more than once is toxic if any label says so; repeated rows score alike, and texts
with the same clauses tie; an empty table gives no rows; a very long text is read whole; other columns may have any name and type.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import append_columns, byte_texts, held_out, learnable, picked
from concord.session import durable

#: Symbols by word. The learned lexicon adds insults to these. Words that are mostly something else
#: in another of the languages, such as an article, are left out.
TARGETS = frozenset("you your yours youre he she they him them toi vous dich dir ihr euch sie tú usted vosotros ustedes".split())
NEGATIONS = frozenset("not never no isnt arent wasnt dont without ne pas jamais nicht kein keine nie nunca jamás".split())
REPORTS = frozenset("said says wrote writes called calls quoted quote alleged claimed according dit disait sagte schrieb dijo escribió".split())
#: Used only where there are no labels to learn from.
INSULTS = frozenset("idiot moron loser scum stupid pathetic worthless disgusting dumb fool".split())
THREATS = frozenset("kill murder destroy hurt strangle stab shoot burn beat tuer détruire töten zerstören matar destruir".split())

#: The alphabet: insults by strength, threat, target, negation, report, other.
WEAK, PLAIN, STRONG, THREAT, TARGET, NEGATION, REPORT, OTHER = "123TGNRo"
INSULT = WEAK + PLAIN + STRONG
SYMBOLS = INSULT + THREAT + TARGET + NEGATION + REPORT + OTHER
_HITS = frozenset(INSULT + THREAT)
STRENGTH = {WEAK: 1.0, PLAIN: 2.0, STRONG: 3.0}
TARGET_REACH, NEGATION_REACH = 4, 3
LIFT, RIDGE = 4.0, 2e-5
#: Weights of the patterns before any label is seen: an insult at somebody, one at nobody, a threat; and what scales them.
DIRECTED, BARE, THREATENED, NEGATED, REPORTED = 1.5, 0.6, 3.0, 0.4, 0.6
#: How far the logarithm of a weight may be expected to move.
SPREAD = 0.7
#: Word beginnings of so many characters can stand for a family of words.
STEMS = (4, 5, 6)
#: The marks that end a clause.
CLAUSE_ENDS = ".!?;\n"
_ASCII_TOKENS = re.compile(rf"[a-z]+|[{CLAUSE_ENDS}]")
#: ASCII other than letters becomes a space.
_SPACED = bytes(c if chr(c).isascii() and chr(c).isalpha() else 0x20 for c in range(256))


@cache
def _unicode_words() -> str:
    """A pattern of words in any script: a letter, then letters and the combining marks they carry.

    Variation selectors choose between forms of a symbol, so they are no part of a word. On ASCII text it
    finds what the ASCII rules find.
    """
    letters, marks = [], []
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))
        if kind[0] == "L":
            letters.append(code)
        elif kind in ("Mn", "Mc") and not 0xFE00 <= code <= 0xFE0F and not 0xE0100 <= code <= 0xE01EF:
            marks.append(code)
    return f"[{_ranges(letters)}][{_ranges(sorted(letters + marks))}]*"


def _ranges(codes: list[int]) -> str:
    """Ascending code points as the inside of a character class."""
    starts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    ends = [c for c, behind in zip(codes, [*codes[1:], -2]) if c + 1 != behind]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


@cache
def _unicode(ends: str = "") -> re.Pattern:
    return re.compile(_unicode_words() + (f"|[{ends}]" if ends else ""))


@dataclass
class Transducer:
    """A deterministic weighted automaton: ``arcs[state][symbol]`` is (next state, weight); state 0 begins a clause."""

    arcs: list[dict[str, tuple[int, float]]]

    def weight(self, symbols: Iterable[str]) -> float:
        """The sum of the weights along the path of ``symbols``."""
        state, total = 0, 0.0
        for symbol in symbols:
            state, w = self.arcs[state][symbol]
            total += w
        return total


def automaton(start: Hashable, step: Callable[[Any, str], tuple[Hashable, float]]) -> Transducer:
    """The automaton of a step function, with the states that can be reached."""
    number, arcs, todo = {start: 0}, [], [start]
    for state in todo:
        arcs.append({})
        for symbol in SYMBOLS:
            after, w = step(state, symbol)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            arcs[-1][symbol] = number[after], w
    return Transducer(arcs)


def compose(left: Transducer, right: Transducer, weigh: Callable[[float, float], float]) -> Transducer:
    """The machine that runs both over the same symbols; ``weigh`` makes one weight of theirs."""

    def step(pair: tuple[int, int], symbol: str) -> tuple[tuple[int, int], float]:
        (a, x), (b, y) = left.arcs[pair[0]][symbol], right.arcs[pair[1]][symbol]
        return (a, b), weigh(x, y)

    return automaton((0, 0), step)


@dataclass(frozen=True)
class Weights:
    """The weights of the patterns' arcs."""

    directed: float = DIRECTED
    bare: float = BARE
    threatened: float = THREATENED
    negated: float = NEGATED
    reported: float = REPORTED


def insults(by: Weights = Weights()) -> Transducer:
    """Weights of insults: full with a target in reach on either side, small without."""

    def step(state: tuple[int, str, int], symbol: str) -> tuple[tuple[int, str, int], float]:
        target, waiting, left = state  # words left in reach of the last target; the insult that waits for one
        if symbol == TARGET:
            made_full = STRENGTH[waiting] * (by.directed - by.bare) if waiting else 0.0
            return (TARGET_REACH, "", 0), made_full
        target, left = max(0, target - 1), max(0, left - 1)
        if symbol in INSULT:
            if state[0]:
                return (target, "", 0), STRENGTH[symbol] * by.directed
            return (target, symbol, TARGET_REACH), STRENGTH[symbol] * by.bare
        return (target, waiting if left else "", left), 0.0

    return automaton((0, "", 0), step)


def threats(by: Weights = Weights()) -> Transducer:
    """Weights of threats: only with a target in reach, on either side."""

    def step(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], float]:
        target, waiting = state
        if symbol == TARGET:
            return (TARGET_REACH, 0), by.threatened if waiting else 0.0
        if symbol == THREAT:
            return (max(0, target - 1), 0 if target else TARGET_REACH), by.threatened if target else 0.0
        return (max(0, target - 1), max(0, waiting - 1)), 0.0

    return automaton((0, 0), step)


def negation(by: Weights = Weights()) -> Transducer:
    """Factors: smaller for some words after a negation."""
    return automaton(0, lambda left, symbol: (NEGATION_REACH, 1.0) if symbol == NEGATION else (max(0, left - 1), by.negated if left else 1.0))


def reported(by: Weights = Weights()) -> Transducer:
    """Factors: smaller behind a word of reported speech, to the end of the clause."""
    return automaton(False, lambda seen, symbol: (seen or symbol == REPORT, by.reported if seen else 1.0))


@cache
def grammar(by: Weights = Weights()) -> Transducer:
    """The composed machine: the patterns' weights add up, negation and reported speech scale them."""
    matches = compose(insults(by), threats(by), lambda x, y: x + y)
    scale = compose(negation(by), reported(by), lambda x, y: x * y)
    return compose(matches, scale, lambda x, y: x * y)


def context_free() -> Transducer:
    """A machine that gives every insult its bare weight and knows no target, threat, negation or report."""
    return automaton(0, lambda state, symbol: (0, BARE * STRENGTH.get(symbol, 0.0)))


#: Machines of one pattern each, and of the factors, as they show in which class an arc's weight is.
_KINDS = ("directed", "bare", "threatened")


def arc_classes(path: str) -> np.ndarray:
    """How much of each class lies on a clause's path: directed, bare and threatened, each alone, negated, reported and both."""
    singles, marks = _single_machines()
    out, states, scales = np.zeros(12), [0] * len(singles), [0] * 2
    for symbol in path:
        factor = 0
        for j, machine in enumerate(marks):
            scales[j], w = machine.arcs[scales[j]][symbol]
            factor += (w != 1.0) << j
        for k, machine in enumerate(singles):
            states[k], w = machine.arcs[states[k]][symbol]
            out[4 * k + factor] += w
    return out


@cache
def _single_machines() -> tuple[list[Transducer], list[Transducer]]:
    alone = [Weights(**{n: float(n == kind) for n in _KINDS}, negated=1.0, reported=1.0) for kind in _KINDS]
    return [compose(insults(w), threats(w), lambda x, y: x + y) for w in alone], [negation(), reported()]


def class_weights(by: Weights) -> np.ndarray:
    """What each class of ``arc_classes`` weighs."""
    return np.array([getattr(by, kind) * x for kind in _KINDS for x in (1.0, by.negated, by.reported, by.negated * by.reported)])


@dataclass
class Grammar:
    """The lexicon transducer, as a map from words and word beginnings to strengths, the composed patterns and the fitted curve."""

    words: dict[str, str] = field(default_factory=dict)
    stems: dict[str, str] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = -2.0
    machine: Transducer = field(default_factory=grammar)

    def symbol(self, word: str) -> str:
        """What the lexicon transducer gives for a word; of several insults that it may be, the strongest."""
        found = max([self.words.get(word, ""), *(self.stems.get(word[:n], "") for n in STEMS if len(word) > n)])
        if found:
            return found
        return THREAT if word in THREATS else TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else OTHER

    def clause_weight(self, words: list[str]) -> float:
        """The weight of one clause: that of its path through the machine."""
        return self.machine.weight("".join(map(self.symbol, words)))

    def evidence(self, text: str, symbol: Callable[[str], str] | None = None) -> float:
        """The clauses' weights, the strongest whole and the others with falling shares; ``symbol`` may remember words."""
        look, clauses, path = symbol or self.symbol, [], []
        for token in [*tokens(text), "."]:
            if token not in CLAUSE_ENDS:
                path.append(look(token))
            elif path:
                # every weight of the patterns hangs on an insult or a threat
                if not _HITS.isdisjoint(path) and (weight := self.machine.weight(path)):
                    clauses.append(weight)
                path = []
        return sum(weight / (1 + 0.5 * k) for k, weight in enumerate(sorted(clauses, reverse=True)))

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, self.slope * evidence + self.offset))))


class Symbols(dict):
    """word -> symbol; a bounded memory that fills itself."""

    def __init__(self, model: Grammar):
        self.model = model

    def __missing__(self, word: str) -> str:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = self.model.symbol(word)
        return found


def spaced_words(text: bytes) -> list[str]:
    """Lower-cased words of a whole text, without clause marks; the words of ``tokens``."""
    if text.isascii():
        return text.translate(_SPACED).lower().decode().split()
    return _unicode().findall(text.decode("utf-8", "replace").lower())


def tokens(text: str) -> list[str]:
    """Lower-cased words and clause marks in their order."""
    text = text.lower()
    return (_ASCII_TOKENS if text.isascii() else _unicode(CLAUSE_ENDS)).findall(text)


def scorer(model: Grammar) -> Callable[[bytes | None], float]:
    """The evidence of a text. Texts without any insult or threat are told apart by word look-ups alone."""
    symbols = Symbols(model)
    symbol = symbols.__getitem__

    def one(text: bytes | None) -> float:
        if not text or _HITS.isdisjoint(map(symbol, spaced_words(text))):
            return 0.0
        return model.evidence(text.decode("utf-8", "replace"), symbol)

    return one


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, toxic, text of about ``sample`` labelled rows outside fold 0, chosen by a hash of the id."""
    known = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity sample")), F.lit(1 << 20)) / float(1 << 20)
    chosen = {r["doc_id"]: int(r["toxic"]) for r in known.where(share < min(1.0, sample / max(1, n))).orderBy("doc_id").limit(2 * sample).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(chosen)  # about ``sample`` ids

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [i for i, d in enumerate(ids) if d in shared.value]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([shared.value[ids[i]] for i in rows], pa.int32()), batch.column(1).take(pa.array(rows, pa.int64()))], names=["doc_id", "toxic", "text"])

    # ids are narrowed before Python sees any text: the share is a cheap test in the scan
    near = docs.where(learnable(F.col("doc_id")) & F.col("text").isNotNull() & (share < min(1.0, sample / max(1, n))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return near.select("doc_id", "text").mapInArrow(pick, f"doc_id {kind}, toxic int, text string")


def _units(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """unit, source, clean: one row for each toxic text's unit with the text's least shingle hash; clean texts are counted per task."""
    clean: Counter[str] = Counter()
    for batch in batches:
        units, groups = [], []
        for toxic, text in zip(batch.column(1).to_pylist(), byte_texts(batch.column(2))):
            words = spaced_words(text)
            mine = {u for w in set(words) for u in _units(w)}
            if toxic:
                group = min((xxhash.xxh64_intdigest(" ".join(s)) for s in zip(words, words[1:], words[2:])), default=xxhash.xxh64_intdigest(" ".join(words))) >> 1
                units += mine
                groups += [group] * len(mine)
            else:
                clean.update(mine)
        yield _counts(units, groups, [0] * len(units))
    items = list(clean.items())
    for start in range(0, len(items), 100_000):
        part = items[start : start + 100_000]
        yield _counts([u for u, _ in part], [None] * len(part), [n for _, n in part])


def _counts(units: list, groups: list, clean: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(groups, pa.int64()), pa.array(clean, pa.int64())], names=["unit", "source", "clean"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> Grammar:
    """Fit the lexicon and the curve on about ``sample`` labelled rows outside fold 0."""
    labelled = durable(_labelled(picked(docs, "doc_id", "text"), picked(labels, "doc_id", "toxic"), sample))
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    toxic, clean = sum(n for t, n in sizes.items() if t), sizes.get(0, 0)
    if not toxic or not clean:
        return Grammar(dict.fromkeys(INSULTS, PLAIN))
    units = labelled.mapInArrow(_unit_counts, "unit string, source long, clean long").groupBy("unit", "source").agg(F.sum("clean").alias("clean"))
    counted = units.groupBy("unit").agg(F.count("source").alias("toxic"), F.sum("clean").alias("clean"))
    room = math.log(max(2, counted.count())) + 2
    # at least LIFT times as frequent in toxic texts as in clean ones; what the sample can teach is bounded by it
    lift = (F.col("toxic") / float(toxic)) >= LIFT * ((F.col("clean") + 0.5) / float(clean))
    candidates = counted.where((F.col("toxic") >= 2) & lift).orderBy(F.desc("toxic"), "unit").collect()
    sure = {r["unit"]: _weight(r, toxic, clean) for r in candidates if _surprise(r["toxic"], r["clean"], toxic / (toxic + clean)) > room}
    sure |= _unexplained(labelled, sure, candidates, toxic, clean)
    return _fit_curve(labelled, _fit_patterns(labelled, _lexicon(sure)))


def _lexicon(weights: dict[str, float]) -> Grammar:
    """Words and word beginnings (marked by *) by strength: the log odds in thirds of what a certain insult has."""
    top = max(weights.values(), default=1.0)
    strength = {u: STRONG if w > 2 * top / 3 else PLAIN if w > top / 3 else WEAK for u, w in weights.items()}
    return Grammar({u: s for u, s in strength.items() if u[-1] != "*"}, {u[:-1]: s for u, s in strength.items() if u[-1] == "*"})


def _surprise(toxic: int, clean: int, rate: float) -> float:
    """Log likelihood ratio of a unit's toxic share against the rate of toxic texts."""
    n = toxic + clean
    return toxic * math.log(toxic / (n * rate)) + (clean * math.log(clean / (n * (1 - rate))) if clean else 0.0)


def _weight(row, toxic: int, clean: int) -> float:
    return math.log((row["toxic"] + 0.5) / (toxic + 1)) - math.log((row["clean"] + 0.5) / (clean + 1))


def _unexplained(labelled: DataFrame, sure: dict[str, float], candidates: list, toxic: int, clean: int) -> dict[str, float]:
    """Further units that recur in toxic texts which no sure unit reaches; such texts are few by construction."""
    model = _lexicon(sure)
    pool = {r["unit"]: r for r in candidates if r["unit"] not in sure}
    shared = labelled.sparkSession.sparkContext.broadcast((model, frozenset(pool)))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, units = shared.value
        one = scorer(known)
        for batch in batches:
            rows = []
            for text in byte_texts(batch.column(2)):
                if not one(text):
                    rows.append(sorted({u for w in set(spaced_words(text)) for u in _units(w)} & units))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["units"])

    texts = [set(r["units"]) for r in labelled.where("toxic = 1").mapInArrow(left, "units array<string>").collect()]
    by_unit: dict[str, set[int]] = defaultdict(set)
    for i, units in enumerate(texts):
        for unit in units:
            by_unit[unit].add(i)
    found: dict[str, float] = {}
    while by_unit:
        unit, reached = max(by_unit.items(), key=lambda x: (len(x[1]), -pool[x[0]]["clean"], pool[x[0]]["toxic"], x[0]))
        if len(reached) < 2:
            break
        found[unit] = _weight(pool[unit], toxic, clean)
        by_unit = {u: rest for u, seen in by_unit.items() if (rest := seen - reached)}
    return found


def hit_paths(text: str, symbol: Callable[[str], str]) -> list[str]:
    """The paths of the clauses that hold an insult or a threat."""
    out, path = [], []
    for token in [*tokens(text), "."]:
        if token not in CLAUSE_ENDS:
            path.append(symbol(token))
        else:
            if not _HITS.isdisjoint(path):
                out.append("".join(path))
            path = []
    return out


def _fit_patterns(labelled: DataFrame, model: Grammar) -> Grammar:
    """The model with the weights of its patterns' arcs fitted to the sample's labels.

    What the paths of a document hold of each class of arcs is computed once; steps of one weight after the other
    are taken while the likelihood grows by more than leaving the weights typed in costs.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(shared.value)
        one = scorer(shared.value)
        for batch in batches:
            paths = [hit_paths(text.decode("utf-8", "replace"), symbols.__getitem__) if text and one(text) else [] for text in byte_texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(paths, pa.list_(pa.string()))], names=["toxic", "paths"])

    rows = labelled.mapInArrow(run, "toxic int, paths array<string>").collect()  # about ``sample``
    y = np.array([1.0 if r["toxic"] else 0.0 for r in rows])
    clauses = [(i, path) for i, r in enumerate(rows) for path in r["paths"]]
    if not clauses:
        return model
    known = {path: arc_classes(path) for path in {path for _, path in clauses}}
    of, held = np.array([i for i, _ in clauses]), np.stack([known[path] for _, path in clauses])

    def cost(by: Weights) -> float:
        weight = held @ class_weights(by)
        order = np.lexsort((-weight, of))
        first = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))
        rank = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        x = np.zeros(len(y))
        np.add.at(x, of[order], weight[order] / (1 + 0.5 * rank))
        a, b = _curve(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(a * x + b, -50, 50))), 1e-9, 1 - 1e-9)
        moved = sum(math.log(getattr(by, n) / getattr(Weights(), n)) ** 2 for n in by.__dataclass_fields__)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()) + moved / (2 * SPREAD**2)

    best, least = Weights(), cost(Weights())
    for _ in range(6):
        before = least
        for name in best.__dataclass_fields__:
            for factor in (0.5, 0.75, 0.9, 1.1, 1.33, 2.0):
                tried = replace(best, **{name: float(np.clip(getattr(best, name) * factor, 0.02, 20.0))})
                if (found := cost(tried)) < least - 1e-6:
                    best, least = tried, found
        if before - least < 1e-3:
            break
    model.machine = grammar(best)
    return model


def _curve(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps with a small ridge."""
    scale = max(1e-9, float(np.median(x[x > 0]))) if (x > 0).any() else 1.0
    x, a, b = x / scale, 1.0, -1.0
    weight = np.full(len(y), 1.0 / max(1, len(y)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g = weight * (p - y)
        h = weight * p * (1 - p) + 1e-9
        grad = np.array([(g * x).sum() + RIDGE * a, g.sum()])
        hess = np.array([[(h * x * x).sum() + RIDGE, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return max(1e-3, float(a)) / scale, min(-0.1, float(b))


def _fit_curve(labelled: DataFrame, model: Grammar) -> Grammar:
    """The model with its curve fitted to the sample's evidence."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([one(t) for t in byte_texts(batch.column(2))], pa.float64())], names=["toxic", "evidence"])

    rows = labelled.mapInArrow(run, "toxic int, evidence double").collect()
    model.slope, model.offset = _curve(np.array([r["evidence"] for r in rows]), np.array([1.0 if r["toxic"] else 0.0 for r in rows]))
    return model


EVIDENCE = T.StructType([T.StructField("__t_evidence", T.DoubleType(), False), T.StructField("__t_score", T.DoubleType(), False)])


def with_toxicity(docs: DataFrame, model: Grammar) -> DataFrame:
    """``docs`` with the columns ``__t_evidence`` and ``__t_score``; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # what about ``sample`` documents taught

    def rows_of() -> Callable[[bytes | None], tuple]:
        known, one = shared.value, scorer(shared.value)

        def row(text: bytes | None) -> tuple:
            found = one(text)
            return found, known.score(found)

        return row

    return append_columns(docs, "text", EVIDENCE, rows_of)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence for every row of ``docs``."""
    judged = with_toxicity(picked(docs, "doc_id", "text"), learn(docs, labels, **options))
    score = F.col("__t_score")
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("__t_evidence").alias("evidence"))

"""Quality rules whose cutoffs are certified on labelled documents that chose nothing.

Base measures come from whole texts. Each rule compares one ratio of them with a cutoff from a fixed scale,
from lenient to strict. Which rules are worth tightening is learned: on the design part of the labels a path is
built that starts with no rule and takes, step by step, the next cutoff of the rule that rejects most bad
documents for each good one. The path is one joint ladder: a step is a set of cutoffs, and each step rejects
all that the steps before it reject.

The holdout, the rest of the labels, then decides how far to go. Steps are tested in order with an exact
binomial test of "more than ``max_false_rejection`` of the good documents are rejected"; testing stops at the
first step that cannot be certified, so the sequence needs no correction of its own, and strata share the error
level by Bonferroni. With probability 1 - delta, in every stratum at most ``max_false_rejection`` of good
documents are rejected by the step that is taken. Copies would count as several trials although they are one:
labelled documents with the same least hash of three words count once, and all of them belong to the same part.
The guarantee is about documents that pass the base rule, which has no error to control; a stratum whose
holdout is too small for any certificate, or whose design part has no bad document that a rule could catch, gets
only the base rule. At the defaults that takes about 220 good
documents without a false rejection in the holdout of each of four strata.

Defined results: a null or empty text has no words and fails the base rule; a null stratum is a stratum
of its own, apart from that of an empty name; an empty table gives no rows; an empty label table certifies nothing; repeated rows are judged
alike, each on its own; a document labelled more than once counts as good if any of its labels says so; of
equally good steps the first rule in order is tightened; a very long text is measured whole; other columns may
have any name and type.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import ASCII_SPACE, CONTINUATION, append_columns, boxed, picked, unboxed
from concord.session import durable, written

MIN_WORDS = 50
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

MEASURES = T.StructType([T.StructField(f"__q_{name}", T.LongType(), False) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "copies")])


def measure(text: bytes | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the number of lines with a word, and what copies share."""
    if not text:
        return (0,) * 7
    words = text.split()
    chars = len(text.translate(None, ASCII_SPACE + CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    distinct = set(windows)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(windows, len(distinct)), len(lines), least_hash(distinct, text)


def least_hash(windows: set[tuple[bytes, ...]], text: bytes) -> int:
    """The least hash of a text's three-word windows, which near copies share as a rule; of the text if it has none."""
    return min(map(xxhash.xxh64_intdigest, map(b" ".join, windows)), default=xxhash.xxh64_intdigest(text)) >> 1


def repeated_words(windows: list[tuple[bytes, ...]], distinct: int) -> int:
    """How many words lie in a 3-word window that occurs at least twice in the text."""
    if distinct == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for start, window in enumerate(windows):
        if times[window] > 1:
            covered += start + 3 - max(start, end)
            end = start + 3
    return covered


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures as columns prefixed ``__q_``; one pass over the texts, no shuffle."""
    return append_columns(docs, text, MEASURES, lambda: measure)


def base_failed() -> Column:
    words, repeats = F.col("__q_n_words"), F.col("__q_n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeats > 50 * words)


@dataclass(frozen=True)
class Rule:
    """Reject when ``value`` lies beyond a cutoff; ``cutoffs`` run from the most lenient to the strictest.

    ``level`` is how many of the cutoffs reject a row, so a row is rejected at cutoff i exactly if it is above i.
    """

    name: str
    numerator: str
    denominator: str
    cutoffs: tuple[float, ...]
    below: bool = False

    def value(self) -> Column:
        return F.col(f"__q_{self.numerator}") / F.greatest(F.col(f"__q_{self.denominator}"), F.lit(1))

    def level(self) -> Column:
        lenient_first = [self.value() < c if self.below else self.value() > c for c in self.cutoffs]
        # a lenient cutoff rejects nothing that a stricter one keeps
        return reduce(lambda a, b: a + b, [x.cast("int") for x in lenient_first])

    def rejects(self, tightened: Column) -> Column:
        """Whether the rule rejects a row when its ``tightened`` first cutoffs are in force; of them the last is strictest."""
        return self.level() > F.lit(len(self.cutoffs)) - tightened


RULES = (
    Rule("symbols_per_word", "n_symbols", "n_words", (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    Rule("repeated_words", "n_repeat_words", "n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("long_words", "word_chars", "n_words", (14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0)),
    Rule("short_words", "word_chars", "n_words", (1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5), below=True),
)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in the log domain."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


#: One part in this many of the labelled groups of copies chooses the path; the others are the holdout.
DESIGN = 5
#: For each rule, how many cutoffs reject, and a document's count: what the driver sees of the labels.
Levels = list[tuple[tuple[int, ...], int]]


def rejected(rows: Levels, step: tuple[int, ...]) -> int:
    """How many documents a step rejects: those beyond the strictest cutoff in force of some rule."""
    return sum(n for levels, n in rows if any(level > len(rule.cutoffs) - taken for level, taken, rule in zip(levels, step, RULES)))


def path(good: Levels, bad: Levels) -> list[tuple[int, ...]]:
    """The joint ladder: from no rule at all, always the next cutoff with the best odds of bad against good rejections."""
    step = (0,) * len(RULES)
    lost, caught, steps = 0, 0, []
    while True:
        options = []
        for i, rule in enumerate(RULES):
            if step[i] < len(rule.cutoffs):
                wider = (*step[:i], step[i] + 1, *step[i + 1 :])
                more_lost, more_caught = rejected(good, wider) - lost, rejected(bad, wider) - caught
                options.append(((more_caught + 0.5) / (more_lost + 0.5), -i, wider))
        if not options:
            return steps
        odds, _, step = max(options)
        lost, caught = rejected(good, step), rejected(bad, step)
        steps.append(step)


def certified_step(holdout: Levels, steps: list[tuple[int, ...]], alpha: float, level: float) -> tuple[int, ...] | None:
    """The strictest step reached by fixed-sequence testing on the good documents of the holdout."""
    n, found = sum(k for _, k in holdout), None
    for step in steps:
        lost = rejected(holdout, step)
        if n == 0 or lost > alpha * n or binomial_tail(lost, n, alpha) > level:
            break
        found = step
    return found


def certify(measured: DataFrame, labels: DataFrame, max_false_rejection: float = 0.02, delta: float = 0.05, max_strata: int = 1000) -> dict[str | None, tuple[int, ...]]:
    """The certified step of each stratum of ``measured`` (doc_id, __q_stratum and the measures), from all its labelled documents.

    Labelled documents are counted by stratum, part, label and levels, so the driver sees a row for each
    combination that occurs, of which the rules allow a fixed number, and no document. More than ``max_strata``
    strata raise an error.
    """
    known = picked(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("__q_id")).agg(F.max("quality").alias("__q_good"))
    rows = measured.where(~base_failed()).join(known, F.col("doc_id") == F.col("__q_id"))
    # copies are one trial: the one with the least id stands for them
    one = rows.groupBy("__q_stratum", "__q_copies", "__q_good").agg(F.min_by(F.array(*[rule.level() for rule in RULES]), "doc_id").alias("levels"))
    part = (F.pmod(F.xxhash64("__q_copies", F.lit("design")), F.lit(DESIGN)) == 0).alias("design")
    table = one.groupBy("__q_stratum", part, "__q_good", "levels").agg(F.count("*").alias("n"))
    cells: dict[str | None, dict[tuple[bool, bool], Levels]] = {}
    for r in table.orderBy("__q_stratum", "levels").collect():
        mine = cells.setdefault(r["__q_stratum"], {})
        if len(cells) > max_strata:
            raise ValueError(f"more than {max_strata} strata; choose a coarser column")
        mine.setdefault((r["design"], r["__q_good"] == 1), []).append((tuple(r["levels"]), r["n"]))
    found = {}
    for stratum, mine in cells.items():
        bad = mine.get((True, False), [])
        steps = path(mine.get((True, True), []), bad)
        step = certified_step(mine.get((False, True), []), steps, max_false_rejection, delta / len(cells))
        caught = rejected(bad, step) if step else 0
        if caught:
            # steps at the end that catch no bad document would only cost good ones
            found[stratum] = next(s for s in steps if rejected(bad, s) == caught)
    return found


def kept(steps: dict[str | None, tuple[int, ...]]) -> Column:
    """The verdict on a row with ``__q_stratum`` and measures: it passes the base rule and the certified step of its stratum."""
    out = F.lit(False)
    for i, rule in enumerate(RULES):
        taken = F.lit(0)
        for stratum, step in steps.items():
            if step[i]:
                taken = F.when(F.col("__q_stratum").eqNullSafe(F.lit(stratum)), step[i]).otherwise(taken)
        out = out | rule.rejects(taken)
    return ~base_failed() & ~out


def _stratified(docs: DataFrame, stratum: str) -> DataFrame:
    """``docs``, boxed, with the stratum beside its columns."""
    return boxed(docs, "doc_id", "text").withColumn("__q_stratum", F.col("text" if stratum == "text" else boxed(docs, "doc_id", "text").columns[docs.columns.index(stratum)]).cast("string"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **risk) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of ``docs``.

    The texts are read once; the small table of measures is written before calibration so that the
    verdict does not read them again.
    """
    measured = durable(with_measures(_stratified(docs, stratum).select("doc_id", "text", "__q_stratum")).drop("text"))
    steps = certify(measured, labels, **risk)
    named = [F.col(f"__q_{name}").alias(name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return measured.select("doc_id", *named, base_failed().alias("base_failed"), kept(steps).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **risk) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    Every text is measured once: the rows are written with their measures, and the verdict reads those back. Null
    and empty texts go, as the base rule says; repeated rows stay or go together; an empty table stays empty; other
    columns may have any name.
    """
    marked, _ = written(with_measures(_stratified(docs, stratum)))
    steps = certify(marked.select("doc_id", "__q_stratum", *MEASURES.names), labels, **risk)
    return unboxed(marked.where(kept(steps)), docs, "doc_id", "text")

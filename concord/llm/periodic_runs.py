"""Periodic runs of words by block matching.

A run is a longest stretch of words of smallest period q that holds q at least four times (and six words). To
find those whose period lies near a power of two B, the text is cut into aligned blocks of B words. A run is so
long that it holds a whole block and the same words again q further on; so blocks are the keys of an
Aho-Corasick automaton over word numbers, the document is searched for them, and an occurrence at a distance
that suits the block's size is a seed. A seed is extended word by word to both sides; stretches that are long
enough and of no smaller period are runs. Sizes 2, 4, 8, ... together suit every period, each by one size.

Three things bound the work. A block of more than ``KEY`` words is looked for by its first ones, and what these
find is extended like any seed, so a search takes a bounded number of steps a word. Words of a run recur within
its period, so a block is a key only if each of its words recurs within the largest distance that its size suits;
texts without repetition have no keys and are not searched. A seed inside a stretch that was already extended by
its period, or inside a run whose period divides its distance, is not extended again. So a text of n words takes
about n log n steps, however repetitive it is.

Rows do not meet: there is no shuffle, and one text is in memory at a time with one size of blocks.

Defined results: a null text, or one without words, has no runs and collapses to the empty text; texts of fewer
than six words have none either; a very long text is one document, whole; repeated rows are each judged, alike;
an empty table gives no rows; other columns may have any name and type. A null id is never planted.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from concord.llm.common import byte_texts, picked

#: A run holds its period so often, and so many words, at least.
TIMES, WORDS = 4, 6
#: A block is looked for by so many of its first words: a search takes as many steps at a word that ends a match.
KEY = 32

Run = tuple[int, int, int]


def distances(size: int) -> tuple[int, int]:
    """The periods that blocks of ``size`` words find: the least and the greatest.

    A run of 4 q words holds a whole block among its first 2 ``size`` - 1 words, and that block again q further
    on, if 2 ``size`` <= 3 q + 1; each period is left to the greatest such size.
    """
    least = lambda b: max(1, -(-(2 * b - 1) // 3))
    return least(size), least(2 * size) - 1


def recurrences(words: np.ndarray) -> np.ndarray:
    """For each word how far on it occurs again; the number of words where it does not."""
    order = np.argsort(words, kind="stable")
    again = words[order[1:]] == words[order[:-1]]
    out = np.full(len(words), len(words), np.int64)
    out[order[:-1][again]] = np.diff(order)[again]
    return out


def _mismatch(words: np.ndarray, at: int, other: int, stop: int, step: int) -> int:
    """How many words on from ``at`` equal those on from ``other``, until ``at`` reaches ``stop``; ``step`` is the direction."""
    total, width = abs(stop - at), 64
    done = 0
    while done < total:
        n = min(width, total - done)
        a, b = at + step * done, other + step * done
        left, right = (words[a : a + n], words[b : b + n]) if step > 0 else (words[a - n + 1 : a + 1][::-1], words[b - n + 1 : b + 1][::-1])
        differs = left != right
        k = int(differs.argmax())
        if differs[k]:
            return done + k
        done, width = done + n, width * 2
    return total


def extended(words: np.ndarray, first: int, end: int, period: int) -> tuple[int, int]:
    """The longest stretch [start, end) of ``period`` around one that is known to have it."""
    right = _mismatch(words, end, end - period, len(words), 1)
    left = _mismatch(words, first - 1, first - 1 + period, -1, -1) if first else 0
    return first - left, end + right


def _prime_factors(n: int) -> Iterator[int]:
    p = 2
    while p * p <= n:
        if n % p == 0:
            yield p
            while n % p == 0:
                n //= p
        p += 1
    if n > 1:
        yield n


def smallest_period(words: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch that holds ``period`` twice or more from ``start`` on has none that divides it."""
    return not any(np.array_equal(words[start : start + period], words[start + p : start + p + period]) for p in (period // f for f in _prime_factors(period)))


def _seeds(words: np.ndarray, blocks: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Block starts and distances: blocks of ``size`` words that occur again at a distance which suits that size."""
    (least, most), width = distances(size), min(size, KEY)
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    key_of: dict[int, int] = {}  # of each block, by its number
    numbers: dict[bytes, int] = {}  # of each content
    for k in blocks.tolist():
        block = words[k * size : k * size + width]
        number = numbers.setdefault(block.tobytes(), len(numbers))
        key_of[k] = number
        if number == len(numbers) - 1:
            machine.add_word(tuple(block.tolist()), number)
    machine.make_automaton()
    low, high = int(blocks[0]) * size, min(len(words), (int(blocks[-1]) + 1) * size + most)
    for end, number in machine.iter(tuple(words[low:high].tolist())):
        x = low + end - width + 1
        k = (x - least) // size  # the one block whose distance to x can suit
        if k * size >= x - most and key_of.get(k) == number:
            yield k * size, x - k * size


def runs_of(words: np.ndarray) -> list[Run]:
    """start, length and period of every run of a text of word numbers, by start, then period."""
    n = len(words)
    if n < WORDS:
        return []
    found: list[Run] = []
    holder = np.full(n, -1, np.int64)  # a run that holds the word
    size, farthest = 2, np.maximum(*(recurrences(words)[: n // 2 * 2].reshape(-1, 2).T))
    while distances(size)[0] * TIMES <= n and len(farthest):
        blocks = np.flatnonzero(farthest <= distances(size)[1])
        seen: dict[int, tuple[int, int]] = {}  # the last stretch of each period
        for first, period in _seeds(words, blocks, size) if len(blocks) else ():
            known = first + period + min(size, KEY)
            start, end = seen.get(period, (0, 0))
            if start <= first and known <= end:
                continue
            k = int(holder[first])
            if k >= 0 and period % found[k][2] == 0 and known <= found[k][0] + found[k][1]:
                continue
            start, end = seen[period] = extended(words, first, known, period)
            if end - start >= max(WORDS, TIMES * period) and smallest_period(words, start, period):
                holder[start:end] = len(found)
                found.append((start, end - start, period))
        pairs = len(farthest) // 2
        farthest, size = np.maximum(farthest[: 2 * pairs : 2], farthest[1 : 2 * pairs : 2]), 2 * size
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that repeat the first period of a run."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def longest(runs: list[Run]) -> Run | None:
    """The run of greatest length; of several the first, then the one of smallest period."""
    return min(runs, key=lambda run: (-run[1], run[0], run[2]), default=None)


def planted(words: list[bytes], doc_id: object) -> list[bytes]:
    """A tail of the text replaced by repetitions of its beginning, in a tenth of the documents, as a hash of the id says."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    return words[:at] + (words[at : at + period] * -(-(n - at) // period))[: n - at]


def _judged(words: list[bytes]) -> tuple[list[Run], list[bytes]]:
    numbers: dict[bytes, int] = {}
    runs = runs_of(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
    return runs, collapsed(words, runs)


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length, period) and the collapsed text of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
        for batch in batches:
            judged = [_judged(text.split() if text else []) for text in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found, _ in judged], kind), pa.array([b" ".join(kept).decode() for _, kept in judged], pa.string())], names=["doc_id", "runs", "collapsed"])

    own = picked(docs, "doc_id", "text")
    id_type = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {id_type}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def digests(docs: DataFrame, rewrite: Callable[[list[bytes], object], list[bytes]] = planted) -> DataFrame:
    """doc_id, n_runs, the longest run and digests of all runs and of the collapsed text, after ``rewrite`` of each text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                found, kept = _judged(rewrite(text.split() if text else [], doc_id))
                start, length, period = longest(found) or (None, None, None)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                rows.append((len(found), start, length, period, 1000 * length // period if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    own = picked(docs, "doc_id", "text")
    id_type = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {id_type}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")

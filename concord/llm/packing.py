"""Best-fit packing of tokenised documents into fixed sequences by the sum-of-squares rule.

A document is tokenised, ended with id 0 and, only if longer than a sequence, cut into whole sequences and
a rest. Whole sequences need no packing. All other pieces are dealt to groups of bounded size, and each
group is packed in one task, longest first: a piece goes where the sum over residual gaps g of (open bins
with gap g)^2 becomes smallest (Csirik et al., 2006). As the pieces of a group are known beforehand, a bin
is opened only where none has room; with a new bin as one more choice the same rule uses 0.4 % more bins.
A group leaves one part-filled bin or so, which its size makes negligible.

A vocabulary that drops white space is applied to runs between ASCII white space, whose ids do not depend on
their neighbours, with a bounded cache of runs in each worker. Its file tells whether it is of that kind; with any
other, whole texts are encoded. The file is read once on the driver and sent along.

Defined results: a null or empty text is the single id 0; an empty table gives no pieces; repeated rows are packed each on its own; a very long
text is tokenised whole and cut; pieces of equal length are placed in the order of their serial numbers; a
piece's place depends on the task that read it, so any two runs agree in everything but the places; other columns
may have any name and type.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import byte_texts, picked
from concord.session import durable

CAPACITY = 2048
_END = b"\0\0\0\0"  # id 0 ends every document
CACHE = 250_000
#: Bytes of text whose runs are looked up together.
SPAN = 4 << 20
_MARKS = re.compile(rb"(?<=[a-z0-9])[!-&(-/:-@\[-`{-~]+(?=[ \n])")


class CachedTokenizer:
    """Token ids of texts by runs between ASCII white space, looked up in two generations of a bounded cache."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.split = drops_white_space(vocabulary)
        if self.split:
            known, suffix = self.tokenizer.get_vocab(), json.loads(vocabulary)["model"]["end_of_word_suffix"]
            self.ends_word = np.zeros(max(known.values()) + 1, bool)
            self.ends_word[[i for token, i in known.items() if token.endswith(suffix)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def shared(cls, vocabulary: str) -> CachedTokenizer:
        """The tokenizer of this worker process, which keeps its cache from task to task."""
        key = hash(vocabulary)
        if key not in _TOKENIZERS:
            _TOKENIZERS.clear()
            _TOKENIZERS[key] = cls(vocabulary)
        return _TOKENIZERS[key]

    def batch(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """The ids of each text and the end id, as little-endian unsigned 32-bit integers."""
        start, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text or b"")
            if size >= SPAN or i == len(texts) - 1:
                split = [runs_of(t) if self.split else [t] if t else [] for t in texts[start : i + 1]]
                known = self.look_up(set().union(*split)).__getitem__
                for runs in split:
                    yield b"".join(map(known, runs)) + _END
                start, size = i + 1, 0

    def look_up(self, runs: set[bytes]) -> dict[bytes, bytes]:
        """A table that has the ids of each of ``runs``: the young generation, or one of their own for whole texts."""
        if not self.split:
            return self.encoded(runs)  # whole texts do not come again as a rule
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        missing = runs - self.young.keys()
        again = missing & self.old.keys()
        self.young.update(zip(again, map(self.old.__getitem__, again)))
        self.young |= self.encoded(missing - again)
        return self.young

    def encoded(self, runs: set[bytes]) -> dict[bytes, bytes]:
        """The ids of each of ``runs``; runs of letters alone are words to the vocabulary and are encoded as one text."""
        found: dict[bytes, bytes] = {}
        letters = [r for r in runs if r.isalpha() or not r.isascii() and r.decode("utf-8", "replace").isalpha()] if self.split else []
        for start in range(0, len(letters), 10_000):
            found |= self.words(letters[start : start + 10_000])
        rest = [r for r in runs if r not in found]
        for start in range(0, len(rest), 10_000):
            part = rest[start : start + 10_000]
            ids = self.tokenizer.encode_batch_fast([r.decode("utf-8", "replace") for r in part], add_special_tokens=False)
            found.update(zip(part, [array("I", x.ids).tobytes() for x in ids]))
        return found

    def words(self, part: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words, told apart by the ids that end a word; empty if they are not one word each after all."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(part):
            return {}
        raw, cuts = ids.tobytes(), (4 * ends).tolist()
        return {r: raw[a:b] for r, a, b in zip(part, [0, *cuts], cuts)}


_TOKENIZERS: dict[int, CachedTokenizer] = {}


def drops_white_space(vocabulary: str) -> bool:
    """Whether a vocabulary reads runs between white space one by one, as ``runs_of`` relies on.

    It does if it composes and lowers letters and folds white space, no more; cuts a text into the parts that a
    pattern without white space finds, and drops the rest; and marks the ends of words. Any other encodes whole texts.
    """
    spec = json.loads(vocabulary)

    def parts(node: dict | None, inner: str) -> list[dict]:
        return [p for part in node[inner] for p in parts(part, inner)] if node and inner in node else [node] if node else []

    normal = {p["type"] for p in parts(spec.get("normalizer"), "normalizers")}
    splits = parts(spec.get("pre_tokenizer"), "pretokenizers")
    cut = splits[0] if splits else {}
    found = cut.get("pattern", {}).get("Regex", "")
    words_alone = cut.get("type") == "Split" and cut.get("behavior") == "Removed" and cut.get("invert") and r"[^\s" in found and found.count(r"\s") == 1
    spaces_kept = any(p["type"] == "ByteLevel" and (p.get("add_prefix_space") or p.get("use_regex")) for p in splits[1:])
    return bool({"Lowercase"} <= normal <= {"NFC", "Replace", "Lowercase"} and words_alone and not spaces_kept and spec["model"].get("end_of_word_suffix"))


def runs_of(text: bytes | None) -> list[bytes]:
    """Runs whose ids follow each other in those of ``text``.

    The vocabulary's normaliser lowers case, so A-Z may be lowered first unless a combining mark follows
    somewhere (it could then compose otherwise); ASCII marks other than the apostrophe between an ASCII letter
    or digit and white space are a word of their own to the vocabulary's splitter in any case. A text with
    ``<|`` may hold the string of a special token, which the tokenizer knows by its exact spelling.
    """
    if not text:
        return []
    if b"\xcc" in text or b"\xcd" in text or b"<|" in text:
        return text.split()
    return _MARKS.sub(rb" \g<0>", text.lower()).split()


PIECES = "doc_id {id_type}, piece int, start long, length long, ids_crc32 long, serial long{ids}"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document. ``serial`` numbers the pieces of a task evenly, whatever their ids are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file
    id_type = docs.schema["doc_id"].dataType.simpleString()
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # lists of runs hold no cycles; searching them for some again and again costs a twentieth of the time
        gc.disable()
        try:
            yield from cut_up(batches)
        finally:
            gc.enable()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = CachedTokenizer.shared(shared.value)
        serial = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows, piece, start, length, crc, serials, kept = [], [], [], [], [], [], []
            for row, ids in enumerate(tokens.batch(byte_texts(batch.column(1)))):
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    rows.append(row)
                    piece.append(k // width)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    serials.append(serial)
                    serial += 1
                    if with_ids:
                        kept.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, serials))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "serial"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES.format(id_type=id_type, ids=", ids array<int>" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed one after another; a bin is opened only where no open one has room."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by residual gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        taken, left = count[size:], count[: capacity - size + 1]
        # change of the sum: one bin less with gap g, one more with gap g - size (none if that is 0)
        change = 2 * (left - taken) + 2
        change[0] = 1 - 2 * taken[0]
        change[taken == 0] = never
        rest = int(change.argmin())
        if taken[rest]:
            bins[i] = open_bins[rest + size].pop()
            count[rest + size] -= 1
            offsets[i] = capacity - rest - size
        else:
            bins[i], made, offsets[i], rest = made, made + 1, 0, capacity - size
        if rest:
            open_bins[rest].append(int(bins[i]))
            count[rest] += 1
    return bins, offsets


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, group_pieces: int = 20_000, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for every piece of ``docs``."""
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    cut = durable(pieces(picked(docs, "doc_id", "text"), vocabulary, capacity, with_ids))
    names = [c for c in cut.columns if c != "serial"]
    whole = cut.where(F.col("length") == capacity).select(*names, (F.col("serial") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = cut.where(F.col("length") < capacity)
    groups = max(1, -(-small.count() // group_pieces))
    dealt = small.withColumn("bin_group", F.pmod(F.xxhash64("serial"), F.lit(groups)).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "serial") + ", sequence_id long, offset long"

    def place(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        """Longest first: large gaps are made while small pieces are left to fill them."""
        lengths = group["length"].to_numpy()
        order = np.lexsort((group["serial"].to_numpy(), -lengths))
        bins, offsets = sum_of_squares(lengths[order], capacity)
        placed = group.take(pa.array(order)).select(names)
        return placed.append_column("sequence_id", pa.array((bins << 24 | key[0].as_py()) * 2)).append_column("offset", pa.array(offsets))

    return whole.unionByName(dealt.groupBy("bin_group").applyInArrow(place, schema))


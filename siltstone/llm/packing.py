"""Operator 1: best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best fit. A fixed number of bins is open, filed by free space; a bitset has
one bit for each amount of free space that some open bin has. A piece goes to the open bin with
the least free space that still holds it (the lowest set bit from its length up). If none holds
it, a bin is opened, and when too many are open, the fullest closes first (the lowest set bit).

Each task packs what it reads, in one pass with tokenisation: no shuffle of texts, memory bounded by
the open bins and one batch. What this leaves is stored, and a second pass packs the pieces of sequences that
have space left anew, by best fit again, so that many small tasks cost no space.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, stored

#: Places before a single space between two words: this tokenizer's own first split always cuts there.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Bins:
    """The open bins of one packer. Sequence ids count up from ``first``."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0):
        self.capacity, self.most, self.next = capacity, open_bins, first
        self.filed: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence id, offset) of a piece of 1 to ``capacity`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            sequence, free = self.next, self.capacity
            self.next += 1
        if free > length:  # a full bin is closed at once
            self.filed[free - length].append(sequence)
            self.bits |= 1 << (free - length)
            self.open += 1
        return sequence, self.capacity - free

    def _take(self, free: int) -> int:
        held = self.filed[free]
        sequence = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.open -= 1
        return sequence


class _Known(dict):
    """Words kept for good, then those of the batch."""

    batch: dict[str, bytes | None] = {}

    def __missing__(self, word: str) -> bytes | None:
        return self.batch[word]


class WordIds:
    """Ids of texts, word by word: what follows a single space is encoded with it and kept.

    The first ``cached`` words that a worker meets are kept for good, so memory is bounded. New
    words of a batch are encoded joined, some hundred a call; every word of such a call starts
    where an id stands for text that starts with a space.
    """

    ready: dict[str, WordIds] = {}

    def __init__(self, tokenizer_file: str, cached: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cached, self.known = cached, _Known()
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how byte-level BPE writes a space

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for i in range(0, len(words), 200):
            group = words[i : i + 200]
            ids = self.whole([" " + " ".join(group)])[0]
            at = np.flatnonzero(self.starts[np.frombuffer(ids, "<u4")]) * 4
            if len(at) == len(group) and not at[0]:
                at = [*at.tolist(), len(ids)]
                yield from zip(group, (ids[a:b] for a, b in pairwise(at)), strict=True)
            else:
                yield from zip(group, self.whole([" " + w for w in group]), strict=True)

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known, cut = self.known, []
        for text in texts:
            words = text.split(" ")
            cut.append(words if all(words) else _CUT.split(text))
        new = [w for w in set().union(*(words[1:] for words in cut)) if w not in known]
        # White space at an end touches the space that was cut at, and the cut may be wrong: no ids, and the text is encoded whole.
        ids = dict.fromkeys(new)
        ids.update(self.words([w for w in new if w and not w[0].isspace() and not w[-1].isspace()]))
        room = self.cached - len(known)
        if room > 0:
            known.update(islice(ids.items(), room))
        known.batch, find = ids, known.__getitem__
        heads = self.whole([words[0] for words in cut])
        for text, words, head in zip(texts, cut, heads, strict=True):
            try:
                if words[0][-1:].isspace():
                    raise TypeError
                yield head + b"".join(map(find, islice(words, 1, None)))
            except TypeError:
                yield self.whole([text])[0]


def token_bytes(texts: list[str], tokenizer_file: str, cached: int) -> Iterator[bytes]:
    """:meth:`WordIds.texts` with what this worker has kept."""
    if tokenizer_file not in WordIds.ready:
        WordIds.ready[tokenizer_file] = WordIds(tokenizer_file, cached)
    return WordIds.ready[tokenizer_file].texts(texts)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0, open_bins: int = 512, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, look_ahead: int = 2048, cached_words: int = 1_000_000) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    A document is its ids, then ``end_id``; null text counts as empty and is ``end_id`` alone. Only
    documents longer than ``capacity`` are cut: all pieces have ``capacity`` tokens but the first,
    which takes the remainder. Within ``look_ahead`` documents the longest pieces go first; then
    best fit leaves least space. At most ``open_bins`` sequences a task are left open, and those of
    64 tasks or so are packed together.

    Rows: the id column (``doc_id``), piece int, start long, length long, ids_crc32 long,
    sequence_id long, offset long and, if ``ids``, the piece's ids as array<int>. Every row
    of ``docs`` is a document of its own: repeated rows and null ids are packed too. Other
    columns are ignored. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, open_bins, TaskContext.get().partitionId() << 36)
        for whole in rows:
            for at in range(0, whole.num_rows, look_ahead):
                batch = whole.slice(at, look_ahead)
                keys = batch.column(0)
                pieces = []
                for i, raw in enumerate(token_bytes([x or "" for x in batch.column(1).to_pylist()], tokenizer_file, cached_words)):
                    raw += end_id.to_bytes(4, "little")
                    size = len(raw) // 4
                    edge = size % capacity or capacity
                    cuts = [0, *range(edge, size + 1, capacity)]
                    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        part = raw[4 * a : 4 * b]
                        pieces.append((b - a, i, n, a, zlib.crc32(part), part if ids else b""))
                pieces.sort(key=lambda p: -p[0])
                placed = [bins.place(p[0]) for p in pieces]
                columns = [
                    keys.take(pa.array([p[1] for p in pieces], pa.int32())),
                    pa.array([p[2] for p in pieces], pa.int32()),
                    *(pa.array([p[k] for p in pieces], pa.int64()) for k in (3, 0, 4)),
                    *(pa.array([x[k] for x in placed], pa.int64()) for k in (0, 1)),
                ]
                names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                if ids:
                    columns.append(pa.array([np.frombuffer(p[5], "<u4").astype("i4") for p in pieces], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * ids
    packed = stored(docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema))
    return merged(packed, capacity, 64 * open_bins)


def merged(packed: DataFrame, capacity: int, together: int) -> DataFrame:
    """``packed`` with the pieces of sequences that are less than 15/16 full packed anew, longest first; some ``together`` such sequences meet in a task."""
    loose = packed.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") * 16 < capacity * 15)
    loose = cut(loose.select("sequence_id"))
    tasks = loose.count() // together + 1

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((-n, s, o) for batch in rows for s, o, n in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        bins, first = Bins(capacity, len(found) + 1), TaskContext.get().partitionId() << 36
        placed = [bins.place(-n) for n, _, _ in found]
        columns = [x[1] for x in found], [x[2] for x in found], [-1 - first - x[0] for x in placed], [x[1] for x in placed]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["sequence_id", "offset", "_to", "_at"])

    pieces = packed.select("sequence_id", "offset", "length").join(loose, "sequence_id", "left_semi").repartition(tasks, F.col("sequence_id"))
    moved = cut(pieces.mapInArrow(run, "sequence_id long, offset long, _to long, _at long"))
    out = packed.join(moved, ["sequence_id", "offset"], "left")
    return out.withColumns({"sequence_id": F.coalesce("_to", "sequence_id"), "offset": F.coalesce("_at", "offset")}).select(*packed.columns)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves from :func:`pack` with ``ids``: sequence_id, n_tokens, ids. Each is ``capacity`` tokens at most."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.flatten(held["ids"]).alias("ids"))

"""Packing documents into training sequences by minimum bin slack.

1.  Each task turns its documents into token ids.  Every full window of a long document is a sequence by itself; what is left of
    each document, shorter than a window, goes to the task's pool.
2.  Whenever the pool holds ``pool`` tokens, windows are taken from it until half is left.  A window takes the longest piece and then
    the multiset of remaining lengths that comes closest to its capacity: a dynamic programme over a bitset (bit s: some choice
    sums to s) goes through the lengths, keeps the bitset before each step, and traces the counts back from the best sum.  With so many
    pieces at hand nearly every window fills exactly; where none does, one more piece is cut and its rest returns to the pool.
3.  A task ends with less than one window of tokens.  These rests of all tasks are dealt to as few partitions as ``pool`` allows and packed
    alike.  The last few tokens of such a partition fill sequences whose lengths are powers of two, so nothing is padded.

No document is collected anywhere: a task holds ``pool`` tokens, and only the rests are exchanged.  Pieces are written to the shared folder
once, so ids are made once.  A sequence's id holds its partition's number, hence the packing follows the input's partitions.

Defined results: a null or empty text is its end id alone; every row is a document of its own, whatever its doc_id (null ones, and those
that come twice, included); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import re
from bisect import bisect_right, insort
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, written

MODEL = "/opt/tokenizers/word_bpe_49k.json"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
SECOND = 1 << 62  # sequences made of rests


class Words(dict):
    """Token ids of a word (as bytes of unsigned 32-bit numbers), by the tokenizer where it is new.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its words.  Nor does it join signs with
    letters before them, and words of Latin letters alone need none of its preparation but lower case and the letters' bytes.
    """

    MOST, LONGEST = 1 << 20, 64
    SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
    LETTERS = "".join(c for c in map(chr, range(0x180)) if c.isalpha() and c.lower().isalpha())

    def __init__(self, model: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(model)
        self.merges = self.tokenizer.model
        self.raw = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        by_byte = ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {ord(c): by_byte.pre_tokenize_str(c.lower())[0][0] for c in self.LETTERS}
        self.plain = re.compile(f"[{self.LETTERS}]+")

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or self.plain.fullmatch(word)):
            lower = word.lower()
            if lower != word:
                found = self[lower]
            else:
                found = b"".join([self.raw[t.id] for t in self.merges.tokenize(word if word.isascii() else word.translate(self.table))])
        else:
            core = word.rstrip(self.SIGNS)
            if core != word and core[-1:].isalpha() and "<|" not in word:
                found = self[core] + self[word[len(core) :]]
            else:
                found = b"".join([self.raw[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = found
        return found

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


class Pool:
    """Pieces ``(doc_id, start, ids, doc_tokens)`` by length, and windows filled from them."""

    def __init__(self):
        self.pieces: dict[int, list] = defaultdict(list)
        self.lengths: list[int] = []  # ascending, those with pieces
        self.tokens = 0

    def add(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        if not self.pieces[n]:
            insort(self.lengths, n)
        self.pieces[n].append(piece)
        self.tokens += n

    def take(self, n: int) -> tuple:
        piece = self.pieces[n].pop()
        if not self.pieces[n]:
            del self.lengths[bisect_right(self.lengths, n) - 1]
        self.tokens -= n
        return piece

    def choose(self, capacity: int) -> list[tuple[int, int]]:
        """``(length, count)`` of the pieces, the longest that fits among them, whose sum is the largest up to the capacity."""
        at = bisect_right(self.lengths, capacity)
        if not at:
            return []
        first = self.lengths[at - 1]
        room = capacity - first
        reach, mask, steps = 1, (1 << room + 1) - 1, []
        for n in reversed(self.lengths[: bisect_right(self.lengths, room)]):
            left, many = min(len(self.pieces[n]) - (n == first), room // n), 1
            while left > 0:
                used = min(many, left)
                steps.append((n, used, reach))
                reach |= reach << n * used & mask
                left, many = left - used, 2 * many
            if reach >> room:
                break
        total, counts = reach.bit_length() - 1, defaultdict(int)
        counts[first] = 1
        for n, used, before in reversed(steps):
            if not before >> total & 1:
                counts[n] += used
                total -= n * used
        return list(counts.items())

    def window(self, capacity: int) -> list[tuple]:
        """Pieces that fill a window exactly; the pool must hold so many tokens."""
        out = [self.take(n) for n, count in self.choose(capacity) for _ in range(count)]
        slack = capacity - sum(len(p[2]) // 4 for p in out)
        if slack:
            # all that is left is longer than the slack, or it would have been chosen
            doc, start, ids, size = self.take(self.lengths[-1])
            out.append((doc, start, ids[: 4 * slack], size))
            self.add((doc, start + slack, ids[4 * slack :], size))
        return out


class _Rows:
    """Output rows by column."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in range(7)]
        self.bytes = 0

    def add(self, piece: tuple, sequence: int | None, offset: int | None) -> None:
        doc, start, ids, size = piece
        for column, x in zip(self.columns, (doc, start, len(ids) // 4, ids, size, sequence, offset), strict=True):
            column.append(x)
        self.bytes += len(ids) + 64

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        self.__init__()
        return out


def _packed(pieces, rows: _Rows, capacity: int, pool: int, base: int, last: bool):
    """Packs a task's pieces; yields whenever ``rows`` holds a few megabytes."""
    waiting, sequence = Pool(), base

    def put(window) -> None:
        nonlocal sequence
        offset = 0
        for p in window:
            rows.add(p, sequence, offset)
            offset += len(p[2]) // 4
        sequence += 1

    for doc, start, ids, size in pieces:
        n = len(ids) // 4
        for s in range(0, n - n % capacity, capacity):
            put([(doc, start + s, ids[4 * s : 4 * (s + capacity)], size)])
        if n % capacity:
            waiting.add((doc, start + n - n % capacity, ids[4 * (n - n % capacity) :], size))
        if waiting.tokens >= pool:
            while waiting.tokens >= max(pool // 2, capacity):
                put(waiting.window(capacity))
        if rows.bytes > 4 << 20:
            yield
    while waiting.tokens >= capacity:
        put(waiting.window(capacity))
        if rows.bytes > 4 << 20:
            yield
    if last:
        while waiting.tokens:
            put(waiting.window(1 << waiting.tokens.bit_length() - 1))
    else:
        for n in list(waiting.lengths):
            for p in waiting.pieces[n]:
                rows.add(p, None, None)
    yield


_WORDS: dict[str, Words] = {}  # one for each Python worker


def _first(model: str, end: int, capacity: int, pool: int):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if model not in _WORDS:
            _WORDS[model] = Words(model)
        words = _WORDS[model]
        close = end.to_bytes(4, "little")

        def pieces():
            for batch in batches:
                for s in range(0, batch.num_rows, 64):
                    part = batch.slice(s, 64)
                    for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                        ids = words.ids(text) + close
                        yield doc, 0, ids, len(ids) // 4

        rows = _Rows()
        for _ in _packed(pieces(), rows, capacity, pool, TaskContext.get().partitionId() << 32, False):
            yield rows.batch()

    return run


def _second(capacity: int, pool: int):
    def run(batches):
        pieces = ((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for batch in batches for r in batch.to_pylist())
        rows = _Rows()
        for _ in _packed(pieces, rows, capacity, pool, SECOND + (TaskContext.get().partitionId() << 32), True):
            yield rows.batch()

    return run


def pack(docs: DataFrame, capacity: int = 4096, model: str = MODEL, end: int = 2, pool: int = 1 << 21) -> DataFrame:
    """Pieces of all rows of ``docs(doc_id, text)``: ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``.

    ``ids``: the piece's token ids as unsigned 32-bit numbers, lowest byte first; ``start``: ids of its document before it; ``offset``: its
    place in its sequence.  ``capacity`` is a power of two; every sequence holds that many tokens, or a smaller power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    rows = pick(docs, doc_id="long", text="string")
    first = written(rows.mapInArrow(_first(model, end, capacity, pool), PIECES))
    rests = first.where("sequence_id is null")
    tokens = rests.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if not tokens:
        return first
    second = written(rests.repartition(math.ceil(tokens / pool)).mapInArrow(_second(capacity, pool), PIECES))
    return first.where("sequence_id is not null").unionByName(second)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

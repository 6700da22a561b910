"""Sampled SentencePiece segmentation by forward filtering and backward sampling, and lossless decoding.

A text (with one space in front, as the model was made) is cut into units, each some spaces and then other
characters; no piece of the vocabulary crosses such a cut, so a text's lattice is the chain of its units'
lattices.  In a unit's lattice, an arc is a piece or, for a character that is no piece of its own, the run of its
byte pieces.  A segmentation has probability in proportion to the product of ``weight ** alpha`` of its arcs.
A byte-pair model carries ranks, not probabilities, so a piece weighs ``1 / (rank + 10)``, Zipf's law over ranks,
and a byte ``exp(-12)``.

*   Forward filtering sums the weights of all ways to reach each position (in logs), for each distinct unit of
    a slice of texts at once.
*   Backward sampling walks every occurrence of every unit from its end, taking arcs by these sums.  The
    random numbers are hashes of (seed, doc_id, unit number, step), so a row's sample depends on nothing else: not on
    partitions, order or retries.
*   Decoding joins the pieces' bytes and drops the space in front.

The vocabulary (some 32,000 pieces) goes to tasks with the function; texts never leave their task.

Defined results: null text has null ids, no pieces, and counts as lossless; empty text has no ids; a null
doc_id is a key of its own; repeated rows get equal samples; other columns are ignored; the literal
character U+2581 is spelled in bytes and so kept apart from a space.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import kernels as K
from .common import pick

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BYTE_LOG = -12.0


@dataclass
class Vocabulary:
    """Pieces that may be arcs, sorted by hash, and the bytes of every id."""

    hashes: np.ndarray  # sorted, with zeros behind
    ids: np.ndarray
    logs: np.ndarray
    lengths: tuple[int, ...]
    bytes_of: np.ndarray  # id of each byte's piece
    data: np.ndarray  # all ids' bytes, joined
    offsets: np.ndarray
    slots: np.ndarray  # where the hashes with each 20-bit prefix begin
    deepest: int  # most hashes with one prefix


@lru_cache
def load(path: str = MODEL) -> Vocabulary:
    """Reads a SentencePiece model on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    spelled: list[bytes] = []
    byte_ids = np.full(256, -1, np.int32)
    arcs: dict[bytes, tuple[int, float]] = {}
    rank = 0
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            spelled.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            raw = piece.replace(SPACE, " ").encode()
            spelled.append(raw)
            body = raw.lstrip(b" ")
            if b" " not in body and not any(c < 32 for c in body):  # else it would cross a cut
                arcs.setdefault(raw, (i, -float(np.log(rank + 10.0))))
            rank += 1
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so it cannot spell every text")
    raw = sorted(arcs)
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = np.append(0, np.cumsum([len(x) for x in raw]))
    hashes = K.range_hash(data, at[:-1], at[1:])
    order = np.argsort(hashes)
    hashes = hashes[order]
    slots = np.searchsorted(hashes, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
    deepest = int(np.diff(np.append(slots, len(hashes))).max())
    return Vocabulary(
        np.append(hashes, np.zeros(deepest, np.uint64)),
        np.array([arcs[x][0] for x in raw], np.int32)[order],
        np.array([arcs[x][1] for x in raw])[order],
        tuple(sorted({len(x) for x in raw})),
        byte_ids,
        np.frombuffer(b"".join(spelled), np.uint8),
        np.append(0, np.cumsum([len(x) for x in spelled])),
        slots,
        deepest,
    )


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the units of joined texts, and the n+1 offsets of each text's units."""
    cut = np.zeros(len(data) + 1, bool)
    space, control = data == 32, data < 32
    cut[1:-1] = (space[1:] & ~space[:-1]) | control[1:] | control[:-1]
    cut[offsets] = True
    cut[-1] = False
    start = np.flatnonzero(cut)
    return start, np.searchsorted(start, offsets)


def lattice(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray, alpha: float):
    """Arcs of joined distinct units, sorted by end: begin, end, id (-1: bytes), and log weight."""
    power, inverse = K.powers(K.BASES[0], len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    lead = (data & 0xC0) != 0x80
    begin = np.flatnonzero(lead)
    room = np.repeat(offsets[1:], np.diff(offsets))[begin] - begin
    after = np.append(begin[1:], len(data))
    width = np.minimum(after - begin, room)
    single = np.zeros(len(begin), bool)
    found = []
    for n in vocab.lengths:
        at = np.flatnonzero(room >= n)
        if not len(at):
            break
        b = begin[at]
        h = K.mix64((total[b + n] - total[b]) * inverse[b])
        where = vocab.slots[h >> np.uint64(44)]
        hit = vocab.hashes[where] == h
        for _ in range(vocab.deepest - 1):  # few slots hold more than one piece
            where = where + ~hit
            hit |= vocab.hashes[where] == h
        hit = np.flatnonzero(hit)
        at, b, where = at[hit], b[hit], where[hit]
        single[at] |= width[at] == n
        found.append((b, b + n, vocab.ids[where], alpha * vocab.logs[where]))
    spell = np.flatnonzero(~single)
    found.append((begin[spell], begin[spell] + width[spell], np.full(len(spell), -1, np.int32), alpha * BYTE_LOG * width[spell]))
    b, e, i, w = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort((e << 20) - (e - b))  # by end, longest first; one key sorts faster than two
    return b[order], e[order], i[order], w[order]


def forward(begin, end, weight, unit_start) -> np.ndarray:
    """Log of the summed weight of all paths from its unit's start to each position.

    ``unit_start`` is the first byte of the arc's unit.  Arcs are filtered by their distance from it, all
    units side by side.
    """
    far = end - unit_start
    reach = np.full(int(end.max(initial=0)) + 1, -np.inf)
    origin = begin == unit_start
    order = np.argsort((far << 32) + np.arange(len(far)))  # by distance, and by end within it
    cuts = np.flatnonzero(np.append(True, np.diff(far[order]) > 0)) if len(order) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        arc = order[lo:hi]
        value = np.where(origin[arc], 0.0, reach[begin[arc]]) + weight[arc]
        head = np.flatnonzero(np.append(True, np.diff(end[arc]) > 0))
        most = np.maximum.reduceat(value, head)
        size = np.diff(np.append(head, len(arc)))
        most = np.where(np.isfinite(most), most, 0.0)
        reach[end[arc[head]]] = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, size)), head))
    return reach


def _random(seed: np.ndarray) -> np.ndarray:
    return (K.mix64(seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def encode(column: pa.Array, keys: np.ndarray, vocab: Vocabulary, alpha: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of each text, joined, and n+1 offsets.  ``keys`` are the rows' 64-bit keys."""
    raw, at = K.string_bytes(column)
    size = np.diff(at)
    full = (size > 0).astype(np.int64)  # empty texts get no space in front
    offsets = np.append(0, np.cumsum(size + full))
    data = np.full(offsets[-1], 32, np.uint8)
    data[K.ranges(offsets[:-1] + full, size)] = raw
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    start, first = units(data, offsets)
    stop = np.append(start[1:], len(data))
    # distinct units; a hash of 64 bits tells them apart
    _, pick_, inverse = np.unique(K.range_hash(data, start, stop), return_index=True, return_inverse=True)
    u_at = np.append(0, np.cumsum(stop[pick_] - start[pick_]))
    u_data = K.gather(data, start[pick_], stop[pick_])
    begin, end, ids, weight = lattice(vocab, u_data, u_at, alpha)
    unit = np.searchsorted(u_at, begin, "right") - 1
    reach = forward(begin, end, weight, u_at[unit])
    origin = begin == u_at[unit]
    share = np.exp(np.where(origin, 0.0, reach[begin]) + weight - reach[end])
    # cumulated shares of the arcs of an end, longest first: most draws stop at the first
    head = np.flatnonzero(np.append(True, np.diff(end) > 0))
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(end))))
    total = np.cumsum(share)
    total -= (total - share)[head][group]
    total[np.append(head[1:], len(end)) - 1] = 2.0  # the last arc takes what rounding leaves
    head_of = np.zeros(len(u_data) + 1, np.int64)
    head_of[end[head]] = head
    # backward, all occurrences at once, those of one unit side by side in memory
    side = np.argsort(inverse, kind="stable")
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[side]
    number = (side - first[doc]).astype(np.uint64)
    base = K.mix64(K.mix64(keys.astype(np.uint64) + np.uint64(seed))[doc] + number)
    where, low = u_at[inverse[side] + 1].copy(), u_at[inverse[side]]
    active = np.arange(len(start))
    spans = np.where(ids < 0, end - begin, 1)
    steps, held = [], np.zeros(len(start), np.int64)
    step = 0
    while len(active):
        arc = head_of[where[active]]
        u = _random(base[active] + np.uint64(0x9E3779B97F4A7C15 * (step + 1) & 0xFFFFFFFFFFFFFFFF))
        on = np.flatnonzero(total[arc] <= u)
        while len(on):
            arc[on] += 1
            on = on[total[arc[on]] <= u[on]]
        steps.append((active, arc))
        held[active] += spans[arc]
        where[active] = begin[arc]
        active = active[begin[arc] > low[active]]
        step += 1
    count = np.empty(len(start), np.int64)
    count[side] = held
    out_at = np.append(0, np.cumsum(count))
    out = np.empty(out_at[-1], np.int32)
    cursor = out_at[1:][side]
    for occ, arc in steps:
        cursor[occ] -= spans[arc]
        plain = ids[arc] >= 0
        out[cursor[occ[plain]]] = ids[arc[plain]]
        if not plain.all():
            o, a = occ[~plain], arc[~plain]
            out[K.ranges(cursor[o], spans[a])] = vocab.bytes_of[u_data[K.ranges(begin[a], spans[a])]]
    return out, out_at[first]


def decode(ids: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes of joined ids, and n+1 offsets."""
    begin, end = vocab.offsets[ids], vocab.offsets[ids + 1]
    data = K.gather(vocab.data, begin, end)
    at = np.append(0, np.cumsum(end - begin))[offsets]
    full = np.diff(at) > 0
    keep = np.ones(len(data), bool)
    keep[at[:-1][full]] = False  # the space in front
    return data[keep], at - np.append(0, np.cumsum(full))


def _encoded(vocab: Vocabulary, alpha: float, seed: int):
    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "text", 3 << 18):
                doc = part.column("doc_id")
                keys = pc.fill_null(doc, -(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                ids, offsets = encode(part.column("text"), keys, vocab, alpha, seed)
                data, at = decode(ids, offsets, vocab)
                raw, raw_at = K.string_bytes(part.column("text"))
                same = np.diff(at) == np.diff(raw_at)
                if same.all():
                    wrong = np.append(0, np.cumsum(data != raw))
                    same &= wrong[at[1:]] == wrong[at[:-1]]
                else:
                    same = np.array([s and bytes(data[a:b]) == bytes(raw[c:d]) for s, a, b, c, d in zip(same, at[:-1], at[1:], raw_at[:-1], raw_at[1:], strict=True)], bool)
                null = part.column("text").is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.where(np.append(null, False), 0, offsets), pa.int32(), mask=np.append(null, False)), pa.array(ids, pa.int32())) if null.any() else K.list_column(ids, offsets, pa.int32())
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.diff(offsets)), lists, pa.array(same)], names=["doc_id", "n_pieces", "ids", "lossless"])

    return run


def encode_documents(docs: DataFrame, model: str = MODEL, alpha: float = 1.0, seed: int = 8) -> DataFrame:
    """``(doc_id, n_pieces, ids, lossless)`` for every row of ``docs(doc_id, text)``; lossless: the ids decode to the text."""
    rows = pick(docs, doc_id="long", text="string")
    return rows.mapInArrow(_encoded(load(model), alpha, seed), "doc_id long, n_pieces long, ids array<int>, lossless boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` of ``encoded(doc_id, ids)``; null ids give null text."""
    vocab = load(model)

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                lists = part.column("ids")
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                data, at = decode(lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size)), vocab)
                text = K.binary_column(data, at, pa.string())
                if lists.null_count:
                    text = pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), text], names=["doc_id", "text"])

    return pick(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")

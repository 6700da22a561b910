"""Scoring by a gated recurrent language model, written in numpy and trained by Spark tasks.

Tokens are words, A-Z lower-cased, and one end per text.  Documents whose ``crc32(doc_id) mod 5`` is 1 are held out.
From all others come, over whole texts, the token counts: the base score, the model's vocabulary, and the
shares of words outside it.

*   Vocabulary: the ``vocabulary`` most frequent words, the end, and ``buckets`` tail classes.  A word outside
    the list belongs to the class of its last two bytes, and has there an add-half share by its count (one
    more share is for all unseen words of the class).  So every text has a probability.
*   Network: embedding, one gated recurrent layer, and a class-factored softmax: P(class) times P(token | class), classes
    being runs of the vocabulary by frequency, of equal shares of its root.  Output biases start at the token frequencies.
*   Training: truncated backpropagation over windows of ``window`` tokens on parallel lanes; a lane carries its state from
    window to window until its document ends (a longer document is dealt to lanes in stretches of ``stretch`` tokens, so that no
    lane runs on alone).  In each of ``rounds`` rounds every partition trains from the
    common weights on its own documents of that round (one in ``every`` by a hash: whole texts, in
    proportion to the input), and the results are averaged, weighted by tokens, in a tree of groups of 16.  As a model grows with
    the root of the input, a round has no more partitions than models fit into an eighth of the input (but as many as Spark runs at once).
*   Scoring: all whole texts, lanes as in training, state carried across windows, reset at each document's start.
*   Counts of words outside the ``head`` most frequent go to documents as in :mod:`.sharded`: keys
    pre-aggregated per slice meet the shard of the count table that holds them; sums per document return.

Defined results: null or empty text is one token, the end; a null doc_id counts as the empty string, so it is not
held out; repeated rows are scored alike (and counted each); other columns are ignored; an empty table gives none; with
nothing to learn from, counts are zero and weights stay as initialised.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import pick, written
from .sharded import Lookup, columns, pack, salts_for, shard_of, unpack

BUCKETS = 64
PASS = "uid long, doc_id long, held_out boolean, words long, known long, base double, score double, shard int, keys binary, size binary, docs binary, times binary"
F32 = np.float32
#: Exponentials that are made at once: with what belongs to them they fit the cache of a core.
BLOCK = 1 << 16
#: Rows of a softmax over classes in scoring.
SCORED = 1024


def buckets_of(words: K.Words) -> np.ndarray:
    """The tail class of each word, from its last two bytes."""
    last = words.data[words.end - 1].astype(np.int64)
    before = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.int64)
    return (last * 31 + before * 7) % BUCKETS


def joined(arrays: dict[str, np.ndarray], w: str, b: str) -> np.ndarray:
    """Weights and their biases in one array, the biases last, of which ``arrays`` hold views from then on."""
    rows, n = arrays[w].shape
    whole = arrays[w].base
    if whole is None or whole is not arrays[b].base or getattr(whole, "shape", None) != (rows, n + 1):
        whole = np.column_stack([arrays[w], arrays[b]])
        arrays[w], arrays[b] = whole[:, :n], whole[:, n]
    return whole


class Network:
    """The weights and their gradients.  ``frequencies`` fall; tokens ``bounds[k]:bounds[k + 1]`` are class k."""

    def __init__(self, frequencies: np.ndarray, hidden: int, classes: int, seed: int):
        size, heaped = len(frequencies), np.cumsum(np.sqrt(frequencies))
        # equal shares of the root of frequency: common words stand in narrow classes, which makes the mean width least
        inner_bounds = np.searchsorted(heaped, heaped[-1] * np.arange(1, classes) / classes, "right")
        self.bounds = np.unique(np.concatenate([[0], inner_bounds, [size]]))
        self.hidden, self.classes = hidden, len(self.bounds) - 1
        self.group = np.repeat(np.arange(self.classes, dtype=np.int16), np.diff(self.bounds))
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / math.sqrt(hidden)).astype(F32)
        mass = np.add.reduceat(frequencies, self.bounds[:-1])
        self.p = {
            "emb": draw(size, hidden), "wx": draw(hidden, 3 * hidden), "wh": draw(hidden, 3 * hidden), "b": np.zeros(3 * hidden, F32),
            "wc": np.zeros((self.classes, hidden), F32), "bc": np.log(mass).astype(F32),
            "ww": np.zeros((size, hidden), F32), "bw": np.log(frequencies / mass[self.group]).astype(F32),
        }

    def run(self, h, prev, reset, keep: bool):
        """States after each of the (steps, lanes) inputs; also, as (steps, features, lanes), these with a one that meets biases, and with ``keep`` what backpropagation needs.

        Inside, features lie over lanes, so that what numpy passes over in a step are long rows.  Arrays are valid until the next call.
        """
        p, n = self.p, self.hidden
        steps, lanes, kind = *prev.shape, p["wh"].dtype
        half, one, stay, opens, held = F32(0.5), F32(1), 1 - reset, reset.any(axis=1), steps if keep else 1
        # sigmoid(x) is 1 / (1 + exp(-x)) and tanh(x) is 1 - 2 / (1 + exp(2x)), cheaper than numpy's tanh; the factors go into the weights
        factor = np.append(np.full(2 * n, -1), np.full(n, 2)).astype(kind)[:, None]
        bias = p["b"][:, None] * factor
        wx, wh, bias, late = p["wx"].T * factor, np.column_stack([p["wh"].T * factor, bias]), bias[2 * n :], bias[2 * n :].any()
        wh[2 * n :, n] = 0  # the candidate's bias is not behind the reset gate
        x, s = self.room("x", (steps, lanes, n), kind), self.room("s", (steps, n + 1, lanes), kind)
        np.take(p["emb"], prev, axis=0, out=x, mode="clip")
        olds, c, gc, zr = (self.room(name, (held, size, lanes), kind) for name, size in (("olds", n + 1), ("c", n), ("gc", n), ("zr", 2 * n)))
        s[:, n] = olds[:, n] = 1
        gx, gh = (self.room(name, (3 * n, lanes), kind) for name in ("gx", "gh"))
        h = h.T
        with np.errstate(over="ignore"):  # beyond the exponential's range a gate is 0 and a candidate 1, as they should be
            for t in range(steps):
                old, both, new = (of[t if keep else 0] for of in (olds, zr, c))
                if opens[t]:
                    np.multiply(h, stay[t], out=old[:n])
                else:
                    old[:n] = h
                np.dot(wx, x[t].T, out=gx)
                np.dot(wh, old, out=gh)
                np.add(gx[: 2 * n], gh[: 2 * n], out=both)
                np.exp(both, out=both)
                both += one
                np.divide(one, both, out=both)
                np.multiply(both[n:], gh[2 * n :], out=new)
                new += gx[2 * n :]
                if late:
                    new += bias
                np.exp(new, out=new)
                new += one
                np.divide(-2 * one, new, out=new)
                new += one
                if keep:
                    np.multiply(gh[2 * n :], half, out=gc[t])
                h = np.subtract(old[:n], new, out=s[t, :n])
                h *= both[:n]
                h += new
        return h.T.copy(), s[:, :n].transpose(0, 2, 1), {"s": s, **({"x": x, "h": olds[:, :n], "zr": zr, "c": c, "gc": gc} if keep else {})}

    def freeze(self):
        self.frozen = self.outputs()
        return self

    def outputs(self):
        """Weights of the classes and of the tokens of each class, biases as the last column."""
        return joined(self.p, "wc", "bc"), joined(self.p, "ww", "bw")

    def room(self, name: str, shape: tuple[int, ...], kind) -> np.ndarray:
        """An array that is kept from window to window."""
        kept, size = self.__dict__.setdefault("_rooms", {}), math.prod(shape)
        if name not in kept or len(kept[name]) < size or kept[name].dtype != kind:
            kept[name] = np.empty(size, kind)
        return kept[name][:size].reshape(shape)

    def by_class(self, tokens):
        """An order of tokens by class, and in it their classes, places inside, and the offsets of each class."""
        group = self.group[tokens]
        order = np.argsort(group, kind="stable")
        group = group[order]
        return order, group, tokens[order] - self.bounds[group], np.searchsorted(group, np.arange(self.classes + 1))

    def outer(self, x, wc, group, reach):
        """Of rows, the softmax over classes: exponentials, where in them each row's class is, its logit, and the sums.

        ``reach`` is the largest sum of a class's absolute weights; rows are shifted only where a value could leave the range.
        """
        e = self.room("outer", (len(x), self.classes), x.dtype)
        np.dot(x, wc.T, out=e)
        if reach * max(x.max(), -x.min()) > 60 and max(e.max(), -e.min()) > 60:
            e -= e.max(axis=1, keepdims=True)
        at = np.arange(0, e.size, self.classes)
        at += group
        mine = e.reshape(-1).take(at)
        np.exp(e, out=e)
        return e, at, mine, e @ np.ones(self.classes, e.dtype)

    def inner(self, x, ww, group, place, cuts):
        """Of rows in class order, the softmax over the tokens of the row's class, in pieces of some classes, whose exponentials fit the cache.

        Yields (rows from, to, tokens from, to, exponentials) of each class met, all exponentials, where in them each row's
        token is, that token's logit, the sums, and the first and last row.
        """
        width, count = np.diff(self.bounds), np.diff(cuts)
        ends = np.cumsum(count * width)
        starts = (ends - (count + cuts[:-1]) * width)[group] + np.arange(len(x)) * width[group]
        limits, tokens, rows = ends.tolist(), self.bounds.tolist(), cuts.tolist()
        met, begun, base, parts = np.flatnonzero(count).tolist(), 0, 0, []
        for k, after in zip(met, [*met[1:], None], strict=True):
            parts.append((rows[k], rows[k + 1], tokens[k], tokens[k + 1], limits[k]))
            if after is not None and limits[after] - base <= BLOCK:
                continue
            flat, done = self.room("inner", (limits[k] - base,), x.dtype), 0
            for m, (i, j, lo, hi, to) in enumerate(parts):
                e = flat[done : to - base].reshape(j - i, hi - lo)
                np.dot(x[i:j], ww[lo:hi].T, out=e)  # has less to do before a small product than matmul
                parts[m], done = (i, j, lo, hi, e), to - base
            if max(flat.max(), -flat.min()) > 60:
                for *_, e in parts:
                    e -= e.max(axis=1, keepdims=True)
            last = rows[k + 1]
            first_of = starts[begun:last] - base
            at = first_of + place[begun:last]
            mine = flat.take(at)
            np.exp(flat, out=flat)
            yield parts, flat, at, mine, np.add.reduceat(flat, first_of), begun, last
            begun, base, parts = last, limits[k], []

    def log_prob(self, states, tokens):
        """Natural log probabilities of tokens after states, both flat."""
        return self.log_probs(np.column_stack([states, np.ones(len(states), states.dtype)]), tokens, np.arange(len(tokens)))

    def log_probs(self, x, tokens, at):
        """Natural log probabilities of tokens after the rows ``at`` of ``x``, states with a one each."""
        (wc, ww), (order, group, place, cuts) = getattr(self, "frozen", None) or self.outputs(), self.by_class(tokens)
        x, back, log, reach = x.take(at[order], axis=0), *np.empty((2, len(tokens)), x.dtype), np.abs(wc).sum(axis=1).max()
        for _, _, _, mine, sums, first, last in self.inner(x, ww, group, place, cuts):
            np.subtract(mine, np.log(sums), out=log[first:last])
        for at in range(0, len(x), SCORED):
            _, _, mine, sums = self.outer(x[at : at + SCORED], wc, group[at : at + SCORED], reach)
            log[at : at + SCORED] += mine - np.log(sums)
        back[order] = log
        return back

    def step(self, h, prev, reset, tokens, mask, rate, squares):
        """One window of truncated backpropagation with Adagrad; returns the state and the loss."""
        p, n = self.p, self.hidden
        last, _, cache = self.run(h, prev, reset, True)
        rows = np.flatnonzero(mask.ravel())
        if not len(rows):
            return last, 0.0
        (steps, lanes), (wc, ww) = prev.shape, self.outputs()
        order, group, place, cuts = self.by_class(tokens.ravel()[rows].astype(np.int64))
        rows, scale, n1 = rows[order], F32(1 / len(rows)), n + 1
        flat = cache["s"].transpose(0, 2, 1).reshape(-1, n1).take(rows, axis=0)
        kind = flat.dtype
        back, more = (self.room(name, flat.shape, kind) for name in ("back", "more"))
        e, at, mine, sums = self.outer(flat, wc, group, np.abs(wc).sum(axis=1).max())
        e.reshape(-1)[at] -= sums
        # rows are scaled on their narrow side, not in the exponentials
        share, log = (scale / sums)[:, None], float((mine - np.log(sums)).sum())
        g_class = e.T @ (flat * share)
        np.dot(e, wc, out=back)
        back *= share
        # large gradients are whole arrays, which makes what passes over them cheap, and are kept from window to window
        g_word = self.room("ww", ww.shape, kind)
        for k in np.flatnonzero(np.diff(cuts) == 0).tolist():
            g_word[self.bounds[k] : self.bounds[k + 1]] = 0
        for parts, e_all, at, mine, sums, first, end in self.inner(flat, ww, group, place, cuts):
            e_all[at] -= sums
            share = (scale / sums)[:, None]
            scaled = flat[first:end] * share
            for i, j, lo, hi, e in parts:
                np.dot(e, ww[lo:hi], out=more[i:j])
                np.dot(e.T, scaled[i - first : j - first], out=g_word[lo:hi])
            more[first:end] *= share
            log += float((mine - np.log(sums)).sum())
        back += more
        d_states = np.zeros((mask.size, n1), kind) if len(rows) < mask.size else self.room("d_states", (mask.size, n1), kind)
        d_states[rows] = back
        d_states = d_states.reshape(steps, lanes, n1)
        # by features: candidates behind the reset gate, update gates, reset gates, candidates; the first three are the state's, the last three the input's
        d = self.room("d", (steps, 4 * n, lanes), kind)
        d_h, d_x, wh = d[:, : 3 * n], d[:, n:], np.roll(p["wh"], n, axis=1)
        dh, stay, opens = np.zeros((n, lanes), kind), 1 - reset, reset.any(axis=1)
        one, spare = F32(1), self.room("spare", (n, lanes), kind)
        for t in range(steps - 1, -1, -1):
            z, r, c, (d_c, d_z, d_r, d_new) = cache["zr"][t, :n], cache["zr"][t, n:], cache["c"][t], d[t].reshape(4, n, lanes)
            dh += d_states[t, :, :n].T
            np.subtract(one, z, out=spare)
            np.multiply(dh, spare, out=d_new)
            np.subtract(cache["h"][t], c, out=d_z)
            d_z *= spare
            dh_z = np.multiply(dh, z, out=dh)
            d_z *= dh_z
            np.multiply(c, c, out=spare)
            np.subtract(one, spare, out=spare)
            d_new *= spare
            np.multiply(d_new, r, out=d_c)
            np.subtract(one, r, out=spare)
            np.multiply(d_c, spare, out=d_r)
            d_r *= cache["gc"][t]
            dh += np.dot(wh, d_h[t], out=spare)
            if opens[t]:
                dh *= stay[t]
        grads = {"wx": (d_x @ cache["x"]).sum(axis=0).T, "b": d_x.sum(axis=(0, 2)), "wh": np.roll((cache["h"] @ d_h.transpose(0, 2, 1)).sum(axis=0), -n, axis=1)}
        d_emb = np.matmul(d_x.transpose(0, 2, 1), p["wx"].T, out=self.room("d_emb", (steps, lanes, n), kind)).reshape(-1, n)
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in (g_class, g_word, *grads.values())))
        cut = F32(min(1.0, 1.0 / max(norm, 1e-9)))
        large = [(g_class, joined(squares, "wc", "bc"), wc), (g_word, joined(squares, "ww", "bw"), ww)]
        for g_all, squared_all, weights_all in [*large, *((g, squares[name], p[name]) for name, g in grads.items())]:
            for at in range(0, len(g_all), 512):  # rows that stay in the cache from one pass to the next
                g, squared, weights = (x[at : at + 512] for x in (g_all, squared_all, weights_all))
                root = self.room("root", g.shape, kind)
                if cut < 1:
                    g *= cut
                np.multiply(g, g, out=root)
                squared += root
                np.sqrt(squared, out=root)
                root += F32(1e-4)
                g /= root
                g *= rate
                weights -= g
        ids = prev.ravel()
        order = np.argsort((ids & 0xFFFF).astype(np.uint16), kind="stable")  # one or two counting sorts
        if len(p["emb"]) > 1 << 16:
            order = order[np.argsort((ids >> 16).astype(np.uint16)[order], kind="stable")]
        ids = ids[order]
        head = np.flatnonzero(np.append(True, np.diff(ids) > 0))
        g, row = np.add.reduceat(d_emb.take(order, axis=0), head, axis=0), ids[head]
        g *= cut
        root = g * g
        root += squares["emb"].take(row, axis=0)
        squares["emb"][row] = root
        np.sqrt(root, out=root)
        root += F32(1e-4)
        g /= root
        g *= rate
        p["emb"][row] = p["emb"].take(row, axis=0) - g
        return last, -log


def lanes_of(length: np.ndarray, count: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first to the emptiest lane; lanes by falling total length."""
    count = max(1, min(count, len(length)))
    heap = [(0, i) for i in range(count)]
    lanes: list[list[int]] = [[] for _ in range(count)]
    for d in np.argsort(-length, kind="stable").tolist():
        load, i = heapq.heappop(heap)
        lanes[i].append(d)
        heapq.heappush(heap, (load + int(length[d]), i))
    return sorted(lanes, key=lambda x: -sum(int(length[d]) for d in x))


def inputs(tokens: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The token before each token of its document; before the first, the end."""
    out = np.append(end, tokens[:-1]).astype(tokens.dtype)
    out[first[:-1]] = end
    return out


def stretches(first: np.ndarray, longest: int) -> np.ndarray:
    """Offsets of documents cut into stretches of at most ``longest`` tokens."""
    length = np.diff(first)
    count = np.maximum(1, -(-length // longest))
    return np.append(K.ranges(np.zeros(len(count), np.int64), count) * longest + np.repeat(first[:-1], count), first[-1])


def lane_windows(tokens: np.ndarray, prevs: np.ndarray, first: np.ndarray, count: int, window: int, widen: int = 1):
    """Windows over lanes: (lanes in use, previous tokens, resets, tokens, positions, mask), all (steps, lanes) but the first.

    Where few lanes are left, a window is up to ``widen`` times as long.
    """
    length = np.diff(first)
    lanes = lanes_of(length, count)
    docs = np.array([d for lane in lanes for d in lane], np.int64)
    where = K.ranges(first[docs], length[docs])
    total = np.array([int(length[lane].sum()) for lane in lanes])
    start = np.append(0, np.cumsum(total))[:-1]
    flat, prev = tokens[where], prevs[where]
    opens = np.zeros(len(flat), bool)
    opens[np.append(0, np.cumsum(length[docs]))[:-1]] = True
    t, last = 0, int(total.max(initial=0))
    while t < last:
        live = int((total > t).sum())
        step = t + np.arange(min(window * min(widen, max(1, len(lanes) // live)), last - t))
        mask = step[:, None] < total[None, :live]
        at = np.minimum(start[None, :live] + step[:, None], len(flat) - 1)
        yield live, prev[at], opens[at].astype(F32), flat[at], where[at], mask
        t += len(step)


class Tokens:
    """Texts as numbers of the model's vocabulary, with an end each."""

    def __init__(self, top: Lookup, bucket_ids: np.ndarray, end: int):
        self.top, self.bucket_ids, self.end = top, bucket_ids, end

    def number(self, words: K.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and n+1 offsets, and which words are outside the list."""
        hit, number = self.top.find(hashes)
        first = words.first + np.arange(len(words.first))
        out = np.full(first[-1], self.end, np.int32)
        out[K.ranges(first[:-1], words.count)] = np.where(hit, number, self.bucket_ids[buckets_of(words)])
        return out, first, ~hit


def _gathered(batch: pa.RecordBatch, tokens: Tokens):
    """The numbers of a whole batch, made slice by slice."""
    parts, sizes = [], []
    for part in K.slices(batch, "text"):
        words = K.split_words(part.column("text"), lower=True)
        out, first, _ = tokens.number(words, words.hashes())
        parts.append(out)
        sizes.append(np.diff(first))
    return np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes)))


def _counted(batches):
    """Word counts of a task, merged as it goes so that its memory follows the distinct words of some batches."""
    held: list[np.ndarray] = []

    def merged():
        word, bucket, n = (np.concatenate(x) for x in zip(*held, strict=True))
        key, at, inverse = np.unique(word, return_index=True, return_inverse=True)
        return key, bucket[at], np.bincount(inverse, n, len(key)).astype(np.int64)

    def out():
        key, bucket, n = merged()
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(bucket.astype(np.int32)), pa.array(n)], names=["word", "bucket", "n"])

    for batch in batches:
        for part in K.slices(batch, "text"):
            words = K.split_words(part.column("text"), lower=True)
            key, at, n = np.unique(words.hashes(), return_index=True, return_counts=True)
            held.append((key, buckets_of(words)[at], n))
            if sum(len(x[0]) for x in held) > 1 << 20:
                held[:] = [merged()]
                if len(held[0][0]) > 1 << 19:
                    yield out()
    if held:
        yield out()


def _trained(net: Network, tokens: Tokens, lanes: int, window: int, stretch: int, rate: float):
    def run(batches):
        K.one_thread()
        local, seen = pickle.loads(pickle.dumps(net)), 0
        squares = {k: np.zeros_like(v) for k, v in local.p.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, first = _gathered(batch, tokens)
            h = np.zeros((lanes, local.hidden), F32)
            for live, prev, reset, tok, _, mask in lane_windows(ids, inputs(ids, first, tokens.end), stretches(first, stretch), lanes, window):
                h, _ = local.step(h[:live], prev, reset, tok, mask, F32(rate), squares)
            seen += len(ids)
        if seen:
            blob = np.concatenate([v.ravel() for v in local.p.values()]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]), pa.array([blob], pa.binary())], names=["i", "n", "blob"])

    return run


def _mean(batches):
    """The mean of the models of a task, weighted by tokens, one model in hand."""
    i, n, total = None, 0.0, None
    for batch in batches:
        for at, weight, blob in zip(batch.column("i").to_pylist(), batch.column("n").to_pylist(), batch.column("blob"), strict=True):
            part = np.frombuffer(blob.as_buffer(), F32) * F32(weight)
            i, n, total = at, n + weight, part if total is None else np.add(total, part, out=total)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([n]), pa.array([(total / F32(n)).tobytes()], pa.binary())], names=["i", "n", "blob"])


def _averaged(parts: DataFrame, net: Network, fan: int = 16) -> None:
    """Sets the network's weights to the mean of the partitions', ``fan`` tasks' at a time, read where they were written: nothing is exchanged."""
    left = parts.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // fan)
        parts = parts.coalesce(left).mapInArrow(_mean, "i long, n double, blob binary")
        parts = written(parts) if left > 1 else parts
    rows = parts.collect()  # one model, or none
    if rows:
        n = np.array([r.n for r in rows])
        flat = sum(np.frombuffer(r.blob, F32) * F32(s) for r, s in zip(rows, n / n.sum(), strict=True))
        at = 0
        for k, v in net.p.items():
            net.p[k] = flat[at : at + v.size].reshape(v.shape).copy()
            at += v.size


def tasks_for(bytes_read: int, model_bytes: int, least: int) -> int:
    """How many tasks of a round may each write a model: all of them together at most an eighth of what is read."""
    return max(least, bytes_read // (8 * model_bytes))


def _scored(net: Network, tokens: Tokens, head: Lookup, tail_logs: np.ndarray, end_log: float, end_known: bool, lanes: int, window: int, shards: int):
    """Model scores, the head's part of the base sums, and requests for the counts of other words."""

    def run(batches):
        K.one_thread()
        net.freeze()
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            if batch.num_rows:
                yield from score(batch, uid)
                uid += batch.num_rows

    def score(batch, uid):
        ids, sizes, sums, known, tails, size_done = [], [], [], [], [], 0
        for part in K.slices(batch, "text"):
            n = part.num_rows
            words = K.split_words(part.column("text"), lower=True)
            hashes = words.hashes()
            out, first, outside = tokens.number(words, hashes)
            hit, log = head.find(hashes)
            doc = words.text
            log = np.where(hit, log, math.log10(0.5))
            sums.append(np.bincount(doc, log, n))
            known.append(np.bincount(doc, hit, n))
            tails.append(np.bincount(doc, np.where(outside, log - tail_logs[buckets_of(words)], 0.0), n))
            ids.append(out)
            sizes.append(np.diff(first))
            rest = np.flatnonzero(~hit)
            if len(rest):
                shard, *columns = pack(hashes[rest], doc[rest], shards)
                yield rows(np.full(len(shard), uid + size_done), *[None] * 6, shard, *columns)
            size_done += n
        ids, first = np.concatenate(ids), np.append(0, np.cumsum(np.concatenate(sizes)))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
        total = np.zeros(batch.num_rows)
        h = np.zeros((min(lanes, batch.num_rows), net.hidden), F32)
        for live, prev, reset, tok, where, mask in lane_windows(ids, inputs(ids, first, tokens.end), first, lanes, window, 16):
            h, _, kept = net.run(h[:live], prev, reset, False)
            at = np.flatnonzero(mask.ravel())
            log = net.log_probs(kept["s"].transpose(0, 2, 1).reshape(-1, net.hidden + 1), tok.ravel()[at].astype(np.int64), at)
            total += np.bincount(owner[where.ravel()[at]], log, batch.num_rows)
        sums, known, tails = (np.concatenate(x) for x in (sums, known, tails))
        words_in = np.diff(first) - 1
        yield rows(np.arange(batch.num_rows) + uid, batch.column("doc_id"), batch.column("held_out"), pa.array(words_in), pa.array(known.astype(np.int64) + int(end_known)), pa.array(sums + end_log), pa.array(total / math.log(10) + tails))

    def rows(uid, *columns):
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), *[pa.binary()] * 4]
        columns = [*columns, *[None] * (11 - len(columns))]
        return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), *[pa.nulls(len(uid), k) if c is None else c for c, k in zip(columns, kinds, strict=True)]], names=["uid", "doc_id", "held_out", "words", "known", "base", "score", "shard", "keys", "size", "docs", "times"])

    return run


def _answer(requests: pa.Table, counts: pa.Table) -> pa.Table:
    """What the counts of one shard add to the documents that ask."""
    n = counts.column("n").to_numpy().astype(float)
    table = Lookup(counts.column("word").to_numpy().view(np.uint64), np.log10(n + 0.5) - math.log10(0.5))
    out: list[list] = [[], [], []]
    for base, keys, size, docs, times in unpack(requests):
        hit, gain = table.find(keys)
        more = np.bincount(docs, np.repeat(gain, size) * times)
        known = np.bincount(docs, np.repeat(hit, size) * times)
        at = np.flatnonzero(known)
        for x, y in zip(out, (base + at, more[at], known[at].astype(np.int64)), strict=True):
            x.append(y)
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return pa.table({"uid": pa.array(join(out[0], np.int64), pa.int64()), "more": pa.array(join(out[1], float), pa.float64()), "seen": pa.array(join(out[2], np.int64), pa.int64())})


def score_documents(docs: DataFrame, vocabulary: int | None = None, hidden: int = 24, classes: int | None = None, rounds: int = 3, every: int | None = None, lanes: int = 512, train_lanes: int = 256, train_window: int = 16, window: int = 32, stretch: int = 1024, rate: float = 0.1, head: int = 1 << 17, shards: int = 64, group_bytes: int = 1 << 25, seed: int = 5) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs(doc_id, text)``, in log10.

    Round r trains on the documents of one hash residue of ``every``, by default ``rounds``, so that each trains once.
    The vocabulary grows by default with the root of the training tokens, the classes with the root of the vocabulary.
    """
    every = every or rounds
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = pick(docs, doc_id="long", text="string").withColumn("held_out", crc % 5 == 1)
    learn = rows.where(~F.col("held_out"))
    counts = written(learn.select("text").mapInArrow(_counted, "word long, bucket int, n long").groupBy("word").agg(F.first("bucket").alias("bucket"), F.sum("n").alias("n")))
    ends = learn.count()
    whole = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    train_tokens, distinct = whole.n + ends, whole.v + (ends > 0)
    vocabulary = vocabulary or max(4000, 2 * math.isqrt(train_tokens))
    classes = classes or max(64, math.isqrt(vocabulary))
    heads = columns(counts.orderBy(F.desc("n"), "word").limit(max(head, vocabulary)).select("word", "bucket", "n"))
    top = {name: x[:vocabulary] for name, x in heads.items()}
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # one row a bucket
    mass, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums:
        mass[r.bucket], kinds[r.bucket] = r.n, r.v
    np.subtract.at(mass, top["bucket"], top["n"].astype(float))
    np.subtract.at(kinds, top["bucket"], 1)
    tail_logs = np.log10(mass + 0.5 * (kinds + 1))
    # the output: words, the end and the buckets, by frequency
    frequency = np.concatenate([top["n"].astype(float), [ends], mass]) + 0.5
    order = np.argsort(-frequency, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    k = len(top["word"])
    tokens = Tokens(Lookup(top["word"].view(np.uint64), number[:k]), number[k + 1 :], int(number[k]))
    net = Network(frequency[order] / frequency.sum(), hidden, classes, seed)
    spark = docs.sparkSession
    tasks = tasks_for(4 * train_tokens, sum(v.nbytes for v in net.p.values()), spark.sparkContext.defaultParallelism)
    for r in range(rounds):
        mine = learn.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(every)) == r % every).select("text")
        _averaged(written(mine.coalesce(tasks).mapInArrow(_trained(net, tokens, train_lanes, train_window, stretch, rate), "i long, n double, blob binary")), net)
    known_heads = Lookup(heads["word"].view(np.uint64), np.log10(heads["n"] + 0.5))
    scanned = written(rows.mapInArrow(_scored(net, tokens, known_heads, tail_logs, math.log10(ends + 0.5), ends > 0, lanes, window, shards), PASS))
    asked = scanned.where("shard is not null")
    salts = salts_for(asked, shards, group_bytes)

    def placed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard_of(batch.column("word").to_numpy().view(np.uint64), shards))], names=["word", "n", "shard"])

    told = counts.select("word", "n").mapInArrow(placed, "word long, n long, shard int").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sent = asked.select("uid", "shard", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int").alias("salt"), "keys", "size", "docs", "times")
    parts = sent.groupBy("shard", "salt").cogroup(told.groupBy("shard", "salt")).applyInArrow(_answer, "uid long, more double, seen long").groupBy("uid").agg(F.sum("more").alias("more"), F.sum("seen").alias("seen"))
    out = scanned.where("shard is null").join(parts, "uid", "left")
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    scale = math.log10(train_tokens + 0.5 * (distinct + 1))
    return out.select(
        "doc_id", "held_out", (F.col("words") + 1).alias("n_tokens"), (F.col("known") + seen).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") + more - (F.col("words") + 1) * scale).alias("base_score"), (F.col("score") + more).alias("score")
    )

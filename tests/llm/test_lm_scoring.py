import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from sievelight.llm import lm_scoring as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def small(hidden=5, size=12, classes=4):
    return L.Network(np.arange(size, 0, -1) / 78, hidden, classes, 3)


def sequence(net, ids, end):
    """One text at a time, one token at a time."""
    net.freeze()
    h, out, prev = np.zeros((1, net.hidden), np.float32), 0.0, end
    for t in ids:
        h, states, _ = net.run(h, np.array([[prev]]), np.zeros((1, 1), np.float32), False)
        out += float(net.log_prob(states[0], np.array([t]))[0])
        prev = t
    return out


def perturbed(net):
    rng = np.random.default_rng(0)
    for v in net.p.values():
        v += (0.3 * rng.normal(size=v.shape)).astype(np.float32)
    return net


def test_probabilities_sum_to_one_and_lanes_equal_sequences():
    net = perturbed(small())
    states = np.random.default_rng(1).normal(size=(3, 5)).astype(np.float32)
    total = sum(np.exp(net.log_prob(states, np.full(3, t))) for t in range(12))
    assert np.allclose(total, 1, atol=1e-5)
    rng = np.random.default_rng(2)
    length = np.array([1, 7, 40, 3, 1, 19])
    first = np.append(0, np.cumsum(length))
    ids = rng.integers(0, 12, first[-1]).astype(np.int16)
    for lanes, window, widen in ((1, 4, 1), (3, 5, 4), (8, 64, 1)):
        net.freeze()
        got, h = np.zeros(6), np.zeros((min(lanes, 6), 5), np.float32)
        owner = np.repeat(np.arange(6), length)
        for live, prev, reset, tok, where, mask in L.lane_windows(ids, L.inputs(ids, first, 0), first, lanes, window, widen):
            h, states, _ = net.run(h[:live], prev, reset, False)
            at = np.flatnonzero(mask.ravel())
            got += np.bincount(owner[where.ravel()[at]], net.log_prob(states.reshape(-1, 5)[at], tok.ravel()[at].astype(np.int64)), 6)
        want = [sequence(net, ids[a:b], 0) for a, b in zip(first[:-1], first[1:], strict=True)]
        assert np.allclose(got, want, atol=1e-3)


def test_gradients():
    """A window's update direction against finite differences, in double precision."""
    net = perturbed(small())
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(4)
    prev, tok = rng.integers(0, 12, (6, 3)), rng.integers(0, 12, (6, 3))
    reset = (rng.random((6, 3)) < 0.2).astype(np.float64)
    h = rng.normal(size=(3, 5))
    old = L.F32
    L.F32 = np.float64
    try:
        def loss(p):
            keep, net.p = net.p, p
            _, states, _ = net.run(h, prev, reset, True)
            out = -net.log_prob(states.reshape(-1, 5), tok.ravel()).mean()
            net.p = keep
            return out

        base = {k: v.copy() for k, v in net.p.items()}
        squares = {k: np.zeros_like(v) for k, v in base.items()}
        net.step(h, prev, reset, tok, np.ones((6, 3), bool), 1e-12, squares)
        scale = None
        for name in ("bc", "wc", "ww", "bw", "wx", "wh", "b", "emb"):
            at = np.unravel_index(np.argmax(squares[name]), base[name].shape)
            up, down = ({k: v.copy() for k, v in base.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            ratio = math.sqrt(squares[name][at]) / abs(slope)  # one clipping factor for all
            scale = scale or ratio
            assert abs(ratio / scale - 1) < 2e-2, name
    finally:
        L.F32 = old


def brute(rows):
    tokens = {i: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, (_, t) in enumerate(rows)}
    held = {i: zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 1 for i, (d, _) in enumerate(rows)}
    count = Counter(x for i, t in tokens.items() if not held[i] for x in t)
    n, v = sum(count.values()), len(count)
    return [(d, held[i], len(tokens[i]), sum(x in count for x in tokens[i]), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens[i]), 6)) for i, (d, _) in enumerate(rows)]


def test_base_scores_and_held_out_gain(spark):
    rng = random.Random(9)
    vocab = {k: [f"{k}{i}" for i in range(300)] for k in ("aa", "bb", "cc")}
    rows = []
    for d in range(400):
        words = vocab[rng.choice(["aa", "bb", "cc"])]
        rows.append((d, " ".join(words[int(300 * rng.random() ** 3)] for _ in range(rng.randint(5, 120)))))
    rows += [(1000, None), (1001, ""), (1002, "Ünseen " * 3), (1003, "aa1 " * 20000), (None, "aa1 bb2"), rows[5], (6, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as TEXT").repartition(3)
    got = L.score_documents(df, vocabulary=200, hidden=8, classes=8, every=2, rounds=4, lanes=32, train_lanes=8, window=8, head=300, shards=3, group_bytes=1 << 10).collect()
    key = lambda r: str((r[0], r[2], r[5]))
    mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=key)
    assert mine == sorted(brute(rows), key=key)
    held = [r for r in got if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.97
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_empty(spark):
    assert L.score_documents(spark.createDataFrame([], "doc_id long, text string"), rounds=1).count() == 0
    only = L.score_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), rounds=1).first()
    assert only.n_tokens == 2 and math.isfinite(only.score)


def test_defaults_train_on_every_document_with_a_growing_vocabulary(spark, monkeypatch):
    rng = random.Random(3)
    df = spark.createDataFrame([(d, " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 20)))) for d in range(200)], "doc_id long, text string")
    mean, seen, sizes = L._averaged, [], []

    def averaged(parts, net):
        seen.append(sum(r.n for r in parts.select("n").collect()))
        sizes.append(len(net.p["emb"]))
        mean(parts, net)

    monkeypatch.setattr(L, "_averaged", averaged)
    row = L.score_documents(df, hidden=4, lanes=16, train_lanes=8).first()
    assert sum(seen) == row.train_tokens and all(seen)
    monkeypatch.setattr(L.math, "isqrt", lambda n: 4500)  # stands for the root of the tokens
    many = spark.createDataFrame([(d, " ".join(f"v{d}x{i}" for i in range(500))) for d in range(20)], "doc_id long, text string")
    L.score_documents(many, hidden=4, classes=64, rounds=1, every=1000, lanes=16, train_lanes=8).first()
    assert sizes[-1] > 7000


def test_stretches_cover_documents():
    first = np.array([0, 5, 5, 12])
    assert L.stretches(first, 3).tolist() == [0, 3, 5, 5, 8, 11, 12]
    assert L.stretches(np.array([0, 0]), 3).tolist() == [0, 0]


def test_supplied_table(spark):
    """Base scores against a direct count; the trained model beats them on held-out documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: [w.translate(LOWER) for w in WORD.findall(r.text or "")] + [None] for r in docs.collect()}
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    count = Counter(w for i, ws in rows.items() if i not in held for w in ws)
    n, v = sum(count.values()), len(count)
    got = L.score_documents(docs).collect()
    assert {r.doc_id for r in got} == set(rows)
    for r in got:
        ws = rows[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(ws), sum(w in count for w in ws), n)
        assert abs(r.base_score - sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6 * len(ws) + 1e-6
    mine = [r for r in got if r.held_out]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine)


def test_models_are_averaged_where_they_were_written(spark, monkeypatch):
    net = small()
    size, kept = sum(v.size for v in net.p.values()), []
    models = np.random.default_rng(5).normal(size=(40, size)).astype(np.float32)
    n = np.arange(1.0, 41)
    monkeypatch.setattr(L, "written", lambda df: kept.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    parts = spark.createDataFrame([(i, float(n[i]), bytearray(models[i].tobytes())) for i in range(40)], "i long, n double, blob binary").repartition(40)
    L._averaged(parts, net)
    want = (models * (n / n.sum())[:, None]).sum(axis=0)
    assert np.allclose(np.concatenate([v.ravel() for v in net.p.values()]), want, atol=1e-5)
    assert kept and all("Coalesce" in p and p.count("Exchange") <= 1 for p in kept)  # the one that deals the rows above
    # all models of a round together are at most an eighth of the input, whatever the number of partitions
    assert L.tasks_for(32_000_000_000, 40_000_000, 8) == 100 and L.tasks_for(10, 1000, 8) == 8


def test_states_lie_by_step_with_lanes_last_and_stay_finite():
    """Passes over a step go over whole rows of lanes; gates far out of the exponential's range end at 0, 1 and -1."""
    net, rng = perturbed(small()), np.random.default_rng(6)
    prev, reset, h = rng.integers(0, 12, (4, 7)), np.zeros((4, 7), np.float32), rng.normal(size=(7, 5)).astype(np.float32)
    with np.errstate(over="raise", invalid="raise", divide="raise"):
        last, states, cache = net.run(h, prev, reset, True)
        assert last.shape == (7, 5) and states.shape == (4, 7, 5)
        assert [cache[k].shape for k in ("zr", "c", "gc", "h")] == [(4, 10, 7), (4, 5, 7), (4, 5, 7), (4, 5, 7)] and all(cache[k].flags.c_contiguous for k in ("zr", "c"))
        p, want = net.p, h
        for t in range(4):
            gx, gh = p["emb"][prev[t]] @ p["wx"] + p["b"], want @ p["wh"]
            z, r = (1 / (1 + np.exp(-(gx + gh)[:, i : i + 5])) for i in (0, 5))
            want = z * want + (1 - z) * np.tanh(gx[:, 10:] + r * gh[:, 10:])
            assert np.allclose(states[t], want, atol=1e-5)
        for sign in (1, -1):
            net.p["b"][:] = sign * 1e4
            _, states, cache = net.run(h, prev, reset, True)
            assert np.isfinite(states).all() and np.allclose(cache["c"], sign) and np.allclose(cache["zr"], max(sign, 0))


def test_weights_lie_with_their_biases_and_exponentials_are_made_in_pieces(monkeypatch):
    """A window copies no weights, and its softmax over words holds no more than a piece, or one class; results are those of one piece."""
    rng = np.random.default_rng(8)
    prev, tok, reset, mask = rng.integers(0, 12, (6, 9)), rng.integers(0, 12, (6, 9)), np.zeros((6, 9), np.float32), rng.random((6, 9)) < 0.8
    done = []
    for block in (1 << 16, 10):
        monkeypatch.setattr(L, "BLOCK", block)
        net = perturbed(small())
        squares = {k: np.zeros_like(v) for k, v in net.p.items()}
        for _ in range(3):
            last, _ = net.step(np.zeros((9, 5), np.float32), prev, reset, tok, mask, np.float32(0.1), squares)
        for whole, w, b in zip(net.outputs(), ("wc", "ww"), ("bc", "bw"), strict=True):
            assert np.shares_memory(whole, net.p[w]) and np.shares_memory(whole, net.p[b])
        x, tokens = rng.normal(size=(50, 5)).astype(np.float32) if not done else done[0][1], np.arange(50) % 12
        order, group, place, cuts = net.by_class(tokens)
        rows = np.column_stack([x, np.ones(50, np.float32)])[order]
        pieces = [(len(parts), flat.size) for parts, flat, *_ in net.inner(rows, net.outputs()[1], group, place, cuts)]
        assert sum(n for n, _ in pieces) == net.classes and (len(pieces) == 1) == (block > 10)
        assert all(n == 1 or size <= block for n, size in pieces)
        done.append((net.log_prob(x, tokens), x, last, *net.p.values()))
    for one, many in zip(*done, strict=True):
        assert np.allclose(one, many, atol=1e-5)

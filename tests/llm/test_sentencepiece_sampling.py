import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievelight.llm import sentencepiece_sampling as S

pytestmark = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no model file")
TEXTS = [None, "", " ", "  two  spaces ", "Hello wörld, ça va?", "tab\tnew\nline\r\n\n", "▁ literal ▁▁x", "日本語 \U0001f600́", "\x00\x01", "aaaa" * 3000, "x " * 9000]


def test_distribution():
    vocab = S.load()
    spelled = {int(i): (bytes(vocab.data[vocab.offsets[i] : vocab.offsets[i + 1]]), float(w)) for i, w in zip(vocab.ids, vocab.logs, strict=True)}
    arcs = {b: w for b, w in spelled.values()}
    word, paths = b" there", {}

    def walk(at, cut, log):
        if at == len(word):
            paths[tuple(cut)] = math.exp(log)
        for e in range(at + 1, len(word) + 1):
            if word[at:e] in arcs:
                walk(e, [*cut, word[at:e]], log + arcs[word[at:e]])

    walk(0, [], 0.0)
    total = sum(paths.values())
    n = 40000
    ids, at = S.encode(pa.array(["there"] * n), np.arange(n, dtype=np.uint64), vocab, 1.0, 1)
    seen = Counter(tuple(spelled[int(i)][0] for i in ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True))
    assert set(seen) <= set(paths)
    for cut, p in paths.items():
        share = p / total
        assert abs(seen[cut] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_round_trip_and_reproducible(spark):
    import sentencepiece

    rng = random.Random(1)
    rows = list(enumerate(TEXTS)) + [(100 + i, "".join(chr(rng.choice([32, 32, 97, 98, 101, 116, 233, 0x4E2D, 0x1F600, 10])) for _ in range(rng.randint(0, 80)))) for i in range(200)]
    rows += [(None, "null key"), (4, TEXTS[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as TEXT")
    a = S.encode_documents(df.repartition(7)).collect()
    b = S.encode_documents(df.repartition(2)).collect()
    key = lambda r: (str(r.doc_id), str(r.ids))
    assert sorted(a, key=key) == sorted(b, key=key)
    assert len(a) == len(rows) and all(r.lossless for r in a)
    assert all(r.n_pieces == len(r.ids or []) for r in a)
    texts = dict(rows)
    back = {r.doc_id: r.text for r in S.decode_documents(S.encode_documents(df)).collect()}
    assert back == texts
    assert [r.ids for r in a if r.doc_id == 0] == [None] and [r.ids for r in a if r.doc_id == 1] == [[]]
    model = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    for r in a:
        if texts[r.doc_id] and "▁" not in texts[r.doc_id] and "\x00" not in texts[r.doc_id]:
            assert model.decode(r.ids) == texts[r.doc_id]


def test_empty(spark):
    assert S.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0

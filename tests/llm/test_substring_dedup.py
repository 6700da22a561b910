import hashlib
import random
import re

import pyarrow as pa

from sievelight.llm import substring_dedup as S
from sievelight.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    words = [(d if d is not None else 1 << 63, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for (d, w), (doc, _) in zip(words, rows, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (d, i):
                gone |= set(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    passages = [[f"p{k}_{i}" for i in range(rng.randint(5, 60))] for k in range(6)]
    rows = [(900, None), (901, ""), (902, "  \n\t "), (903, "é " * 45), (904, "be " * 3000), (905, " ".join(f"x{i % 700}" for i in range(5000)))]
    for d in range(60):
        text = []
        for _ in range(rng.randint(1, 5)):
            text += rng.choice(passages) if rng.random() < 0.6 else [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 30))]
        rows.append((d, rng.choice([" ", "\n", "  \t"]).join(text)))
    rows += [(200, rows[20][1]), (201, rows[20][1]), (20, rows[20][1]), (None, rows[30][1])]
    for size in (20, 4):
        got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), size)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, size)


def test_passes_may_slice_differently(spark, monkeypatch):
    """Repeats that one slice of the first pass holds together stand in two slices of the second."""
    rng = random.Random(9)
    passages = [" ".join(f"q{k}_{i}" for i in range(50)) for k in range(8)]
    rows = [(d, " ".join([f"a{rng.random()}", passages[d // 2 % 8] if d < 16 else "", f"b{rng.random()}"])) for d in range(24)]
    first, second = S._minimisers, S._pack

    def whole(size):
        run = first(size)
        return lambda batches: run(pa.Table.from_batches(list(batches)).combine_chunks().to_batches())

    def single(size, hot):
        run = second(size, hot)
        return lambda batches: run(b.slice(i, 1) for b in batches for i in range(b.num_rows))

    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(S, "_minimisers", whole)
    monkeypatch.setattr(S, "_pack", single)
    assert sorted(map(tuple, remove_repeats(df).collect()), key=str) == brute(rows, 20)
    monkeypatch.undo()
    old = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000")
    try:
        assert sorted(map(tuple, remove_repeats(df).collect()), key=str) == brute(rows, 20)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", old)


def test_hot_minimisers_are_split(spark):
    rng = random.Random(2)
    phrase = "one two three four five six"
    rows = [(d, " ".join([*(f"a{rng.randint(0, 3)}" for _ in range(12)), phrase, *(f"b{rng.randint(0, 2)}" for _ in range(18))])) for d in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).selectExpr("doc_id", "hash(text) as tag", "text")
    for most in (1 << 17, 2):
        got = {}
        for r in S.repeated_ranges(df, 20, hot_runs=3, most_hot=most).collect():
            got.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
        assert {(d, n) for d, _, n, _ in brute(rows, 20) if n} == {(d, len(x)) for d, x in got.items()}


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string, TEXT int")).count() == 0

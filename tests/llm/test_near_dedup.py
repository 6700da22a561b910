import random
import re

import pytest

from sievelight.llm.near_dedup import bands_for, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, percent):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(900)]
    rows = [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE two"), (1004, "one two three"), (1005, "Été café")]
    for base in range(12):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 400))]
        for copy in range(rng.randint(1, 9)):
            edited = list(words)
            for _ in range(rng.randint(0, len(words) // 30)):
                edited[rng.randrange(len(edited))] = rng.choice(vocab)
            rows.append((base * 20 + copy, " ".join(edited)))
    rows.append((500, "long " * 40000))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_matches_brute_force(spark, corpus, percent):
    got = near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string").repartition(5), percent=percent, block=3)
    assert {tuple(r) for r in got.collect()} == brute(corpus, percent)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "a b c d e f", 2), (1, "A b c d e f", 0)], "doc_id long, text string, TEXT int")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)], key=str)


def test_texts_that_share_a_doc_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (5, b + " more"), (6, a + " more"), (7, b), (2, "z " * 9), (2, a)]
    got = sorted(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect())
    assert [(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id > 2] == [(5, 1, False), (6, 1, False), (7, 1, False)]
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id < 3} == {(1, 56, 1), (2, 1, 2), (2, 56, 1)}


def test_bands():
    for percent in (80, 85, 95):
        n = bands_for(percent, 1e-6)
        assert (1 - (percent / 100) ** 5) ** n <= 1e-6 < (1 - (percent / 100) ** 5) ** (n - 1)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0

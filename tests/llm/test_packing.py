import random
import zlib
from collections import defaultdict
from itertools import product

import pytest
from tokenizers import Tokenizer

from sievelight.llm.packing import MODEL, Pool, Words, digests, pack


def check(rows, docs, capacity=4096):
    """Every id of every document in one piece, every sequence without a gap and without padding."""
    tokenizer = Tokenizer.from_file(MODEL)
    want = sorted((i is not None, i or 0, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity and at & (at - 1) == 0
    total = sum(len(ids) for *_, ids in want)
    assert sum(r.length for r in rows) == total
    full = sum(sum(p.length for p in x) == capacity for x in by_sequence.values())
    assert full == total // capacity or len(by_sequence) - full <= 12
    for known, i, ids in want:
        mine = by_doc[i if known else None]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        for p in mine:
            if p.doc_tokens == len(ids) and p.start + p.length <= len(ids):
                fits = zlib.crc32(raw[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32
                assert fits or sum(a == known and b == i for a, b, _ in want) > 1
    for known, i, _ in want:
        mine = sorted((p.start, p.length) for p in by_doc[i if known else None])
        if sum(a == known and b == i for a, b, _ in want) == 1:
            assert [s for s, _ in mine] == [sum(n for _, n in mine[:k]) for k in range(len(mine))]


def words(rng, n):
    return " ".join(rng.choice(["the", "Quick", "brown,", "fox's", "jumps!?", "naïve", "İstanbul", "ΣΑΣ", "x1y22", "<|endoftext|>", "a\tb", "it's.", "é.", "...", ""]) for _ in range(n))


def test_words_are_the_tokenizer_s():
    rng = random.Random(3)
    known, tokenizer = Words(MODEL), Tokenizer.from_file(MODEL)
    odd = ["", " ", "\n\n a", "Don't.", "we'LL,", "x.Y.", "é ́a", "A B　c", "ﬁ", "中文 字", "😀.", "\x00\x1c d", "<|startoftext|>.", "'s", "a's.", "1.", "Ａ.", "'.", "'s'.", "a'.", "b':", "x" * 200 + "."]
    odd += [f"{a}{b}{c}" for a in ("Mot", "ÉTÉ", "ŉaß", "İa", "ǅa", "e\u0301te", "Σας", "ſ", "ªº", "a1", "<|endoftext|>", "x<|endoftext", "'s") for b in ("", "$$$", "<|endoftext|>", "'", "|>", "_", "'re", "\u0301.") for c in ("", ".", "z")]
    for text in [*odd, *(words(rng, 40) for _ in range(40)), *("".join(map(chr, (rng.randrange(1, 0x2FFF) for _ in range(60)))) for _ in range(200))]:
        got = known.ids(text)
        assert [int.from_bytes(got[k : k + 4], "little") for k in range(0, len(got), 4)] == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_choice_has_least_slack():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.randrange(5, 40)
        lengths = [rng.randrange(1, 20) for _ in range(rng.randrange(1, 9))]
        pool = Pool()
        for k, n in enumerate(lengths):
            pool.add((k, 0, bytes(4 * n), n))
        chosen = pool.choose(capacity)
        fits = [n for n in lengths if n <= capacity]
        if not fits:
            assert chosen == []
            continue
        assert all(lengths.count(n) >= c > 0 for n, c in chosen)
        first = max(fits)
        rest = lengths.copy()
        rest.remove(first)
        best = max(s for s in (first + sum(n for n, x in zip(rest, use, strict=True) if x) for use in product((0, 1), repeat=len(rest))) if s <= capacity)
        assert sum(n * c for n, c in chosen) == best


def test_pack(spark):
    rng = random.Random(2)
    docs = [(i, words(rng, rng.choice([0, 1, 3, 30, 200, 800]))) for i in range(300)]
    docs += [(1000, words(rng, 9000)), (1001, None), (1002, ""), (None, "no id"), (None, "no id either, but longer"), (5, words(rng, 7)), (6, docs[6][1])]
    docs += [(2000 + i, "same text") for i in range(400)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, DOC_ID int, Ids string").repartition(7)
    out = pack(frame)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    check(digests(out).collect(), docs)
    # a pool so small that windows must cut, and small windows
    few = digests(pack(frame, capacity=64, pool=128)).collect()
    assert max(sum(1 for r in few if r.sequence_id == s) for s in {r.sequence_id for r in few}) > 1
    total = sum(r.length for r in few)
    by = defaultdict(int)
    for r in few:
        by[r.sequence_id] += r.length
    assert sum(by.values()) == total and all(n <= 64 and n & (n - 1) == 0 for n in by.values())
    assert total == sum(r.length for r in digests(out).collect())


def test_one_and_none(spark):
    one = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    check(digests(pack(one)).collect(), [(1, "one two three four")])
    assert pack(one.limit(0)).count() == 0
    with pytest.raises(ValueError, match="power"):
        pack(one, capacity=100)

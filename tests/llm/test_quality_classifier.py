import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sievelight.llm.quality_classifier import classify

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def discounts(counts):
    n = [sum(c == i for c in counts.values()) for i in range(1, 5)]
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i / 2 for i in (1, 2, 3)]
    return [min(max(d, 0.05), i - 0.05) for i, d in zip((1, 2, 3), raw)]


class Model:
    """The textbook recursion over dictionaries."""

    def __init__(self, texts):
        count = Counter(w for t in texts for w in WORD.findall(t))
        self.vocab = {w for w, c in count.items() if c > 1}
        self.kinds = len(count) - len(self.vocab) + 1
        self.size = len(self.vocab) + 2
        three = Counter()
        for t in texts:
            s = self.padded(t)
            three.update(zip(s, s[1:], s[2:]))
        two = Counter(k[1:] for k in three)
        one = Counter(k[1:] for k in two)
        self.levels = [(c, discounts(c)) for c in (one, two, three)]
        self.context = [defaultdict(lambda: [0, 0.0]) for _ in range(3)]
        for i, (c, d) in enumerate(self.levels):
            for k, v in c.items():
                x = self.context[i][k[:-1]]
                x[0] += v
                x[1] += d[min(v, 3) - 1]

    def padded(self, t):
        return ["<s>", "<s>", *(w if w in self.vocab else "<unk>" for w in WORD.findall(t or "")), "</s>"]

    def p(self, gram):
        i = len(gram) - 1
        lower = self.p(gram[1:]) if i else 1 / self.size
        c, d = self.levels[i]
        total, mass = self.context[i].get(gram[:-1], (0, 0.0))
        if not total:
            return lower
        return (c[gram] - d[min(c[gram], 3) - 1] if c[gram] else 0) / total + mass / total * lower

    def score(self, t):
        s = self.padded(t)
        return sum(math.log(self.p(tuple(s[i - 2 : i + 1]))) for i in range(2, len(s))) - s.count("<unk>") * math.log(self.kinds)


def test_matches_the_recursion_and_separates(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(rng.choice(vocab[: rng.randint(1, 60)]) for _ in range(rng.randint(30, 120)))
    rows = [(i, text(), "en" if i % 2 else None) for i in range(260)]
    rows += [(1000 + i, " ".join(f"ZZ{rng.randint(0, 10**9)}!!" for _ in range(60)), "en") for i in range(10)]
    rows += [(2000, None, "en"), (2001, "", "en"), (2002, "w1 " * 5000, "xx"), (None, rows[0][1], "en"), rows[3]]
    labels = [(i, 1, 0) for i in range(200)] + [(i, 0, 0) for i in range(200, 230)] + [(230, 1, 1), (231, None, None), (None, 1, 0), (3, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as LANG").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = classify(df, lab, head=50, shards=3, parts=3, prior=5, quantile=0.9, group_bytes=1 << 10).collect()
    held = {r.doc_id for r in spark.range(200).toDF("doc_id").where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) == 0).collect()}
    model = Model([t for i, t, _ in rows if i is not None and i < 200 and i not in held])
    texts = {(i, lang): t for i, t, lang in rows}
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id, r.lang]
        n = len(WORD.findall(t or ""))
        assert r.n_words == n
        assert abs(r.log_prob - model.score(t)) < 1e-6 * max(1, abs(r.log_prob))
        assert abs(r.perplexity / math.exp(-r.log_prob / (n + 1)) - 1) < 1e-9
        assert r.kept == (n > 0 and r.perplexity <= r.threshold)
    assert not any(r.kept for r in got if r.doc_id is not None and 1000 <= r.doc_id < 1010)
    assert sum(r.kept for r in got if r.doc_id is not None and r.doc_id < 260) > 230


def test_empty_and_untrusted(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.kept) for r in classify(docs, none).collect()} == {(1, True), (2, False)}
    assert classify(docs.limit(0), none).count() == 0

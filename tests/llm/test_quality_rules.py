import random
import re
from collections import Counter, defaultdict

from sievelight.llm.quality_rules import judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute(rows, min_docs, share, keep):
    texts, lines = defaultdict(set), defaultdict(set)
    for doc, text, host in rows:
        text = text or ""
        texts[host].add((doc, text))
        for line in text.split("\n"):
            if WORD.search(line):
                lines[host, " ".join(WORD.findall(lower(line)))].add((doc, text))
    common = {k for k, v in lines.items() if len(v) > min_docs and len(v) > share * len(texts[k[0]])}
    out = []
    for doc, text, host in rows:
        text = text or ""
        words = WORD.findall(text)
        full = [x for x in text.split("\n") if WORD.search(x)]
        tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        hit = {j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        gone = sum(len(WORD.findall(x)) for x in full if (host, " ".join(WORD.findall(lower(x)))) in common)
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        out.append((doc, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(hit), failed, not failed and len(words) - gone >= keep * len(words), gone))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    shared = ["Home | About  us", "home | ABOUT us", "Éa <b> & 100% $"]
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t\n", "b"), (4, "be " * 500, "a"), (5, "x\n" * 9, "a"), (6, "w" * 30000, None), (7, "a\n\n b\r\nb", "b")]
    for d in range(100, 190):
        body = ["", " "]
        for _ in range(rng.randint(1, 12)):
            body.append(rng.choice(shared) if rng.random() < 0.4 else " ".join(f"é{rng.randint(0, 300)}" for _ in range(rng.randint(1, 25))))
        rng.shuffle(body)
        rows.append((d, "\n".join(body), rng.choice(["a", "a", "b", None])))
    rows += [rows[20], rows[21], (None, rows[22][1], "a"), (rows[23][0], rows[24][1], "a")]
    rows += [(300 + i, "copied line " * 20 + "\n" + "w " * 30, "copies") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "0 as Text").repartition(4)
    for args in ((5, 0.2, 0.5), (1, 0.0, 0.9)):
        assert sorted(map(tuple, judge(df, *args).collect()), key=str) == brute(rows, *args)


def test_empty(spark):
    assert judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from sievelight.llm import kernels as K
from sievelight.llm.language_id import CELLS, identify, train

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
VOCAB = {"en": ["the", "of", "and", "house", "thing", "with", "river"], "de": ["der", "und", "straße", "schön", "nicht", "haus", "zeit"], "fr": ["le", "être", "maison", "avec", "où", "rivière", "et"]}


def cell(gram):
    a, b, c = gram
    x = ((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (c * 0xC2B2AE3D)) & 0xFFFFFFFF
    return ((x * 0x27D4EB2F) & 0xFFFFFFFF) >> 16


def grams(text):
    out = []
    for w in WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())):
        w = b" " + w + b" "
        out += [cell(w[i : i + 3]) for i in range(len(w) - 2)]
    return out


def brute(docs, pages, evidence=40.0, least=0.5, trust=0.5, smooth=20.0):
    langs = sorted({x for _, t, x, _ in docs if x and t is not None})
    counts = {x: Counter() for x in langs}
    for _, t, x, _ in docs:
        if x and t is not None:
            counts[x].update(grams(t))
    size = {x: sum(c.values()) + 0.5 * CELLS for x, c in counts.items()}
    cues = {}
    for p, url, html in sorted(pages, key=lambda r: r[1] or "", reverse=True):
        m = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", html or "")
        rest = url.split("://", 1)[1] if url and "://" in url else None
        host = re.match(r"[^/?#:]*", rest)[0].lower() if rest is not None else None
        path = re.match(r"[^/?#]*/([A-Za-z]{2})(?=[/?#]|\Z)", rest or "")
        cues[p] = (m[1].lower() if m else None, ("/" + path[1].lower() if path else host.split(".")[-1] or None) if host is not None else None, host or None)
    rows = []
    for d, t, _, source in docs:
        g = grams(t)
        scale = min(1.0, evidence / len(g)) if g else 1.0
        logs = [scale * sum(math.log((counts[x][c] + 0.5) / size[x]) for c in g) for x in langs]
        best = max(range(len(langs)), key=lambda i: (logs[i], -i)) if g else None
        declared, suffix, host = cues.get(d, (None, None, None)) if d is not None else (None, None, None)
        host = host if host is not None else "source:" + (source if source is not None else "?")
        rows.append((d, logs, best, declared, suffix, host))
    tables = []
    for k in (3, 4):
        n = Counter((r[k], r[2]) for r in rows if r[k] is not None and r[2] is not None)
        tables.append((n, Counter(r[2] for r in rows if r[k] is not None and r[2] is not None), len({c for c, _ in n})))
    zone = lambda h: h.split(".")[-1]
    everywhere, zones, hosts = Counter(), defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        if r[2] is not None:
            everywhere[r[2]] += 1
            zones[zone(r[5])][r[2]] += 1
            hosts[r[5]][r[2]] += 1
    total = sum(everywhere.values()) + len(langs)
    out = []
    for d, logs, best, declared, suffix, host in rows:
        post = []
        for i, x in enumerate(langs):
            base = (everywhere[i] + 1) / total
            own = Counter([best] if best is not None else [])
            z, h = Counter(zones.get(zone(host), {})), Counter(hosts.get(host, {}))
            z.subtract(own)
            h.subtract(own)
            base = (z[i] + smooth * base) / (sum(z.values()) + smooth)
            value = logs[i] + math.log((h[i] + smooth * base) / (sum(h.values()) + smooth))
            for (n, sums, kinds), cue in zip(tables, (declared, suffix), strict=True):
                if cue is not None and any(c == cue for c, _ in n):
                    value += trust * math.log((n[cue, i] + 1) / (sums[i] + kinds + 1))
            post.append(value)
        top = max(post)
        sure = 1 / sum(math.exp(v - top) for v in post)
        out.append((d, langs[post.index(top)], round(sure, 9), langs[best] if best is not None else None, declared, suffix, host, sure < least))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(6)
    docs, pages = [(500, None, "en", "s1"), (501, "", None, None), (502, "?", "fr", "s2"), (503, "THE River é " * 4000, "en", "s1")], []
    for d in range(120):
        lang = rng.choice(["en", "en", "de", "fr"])
        text = " ".join(rng.choice(VOCAB[lang if rng.random() < 0.9 else "en"]) for _ in range(rng.randint(1, 60)))
        docs.append((d, rng.choice(["", "\n"]).join([text, ""]), lang if rng.random() < 0.8 else None, f"s{d % 5}"))
        if d % 3 == 0:
            shown = lang if rng.random() < 0.8 else "en"
            pages.append((d, f"http://H{d % 4}.example.{rng.choice(['com', 'org'])}:80/{shown}/x?y", f"<!doctype html><html class=a lang='{shown.upper()}'><body>"))
    pages += [(0, "http://zzz.net/", "<html lang=fr>"), (500, None, None), (501, "http://only.host", ""), (502, "http://a.de/FR", "<p>"), (None, "http://a.de", "")]
    docs += [docs[10], (None, docs[11][1], "de", None)]
    return docs, pages


def test_matches_brute_force(spark, tables):
    docs, pages = tables
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as LANG").repartition(4)
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [(r[0], r[1], round(r[2], 9), *r[3:]) for r in map(tuple, identify(d, p).collect())]
    want = brute(docs, pages)
    close = lambda a, b: a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4 and a[3:] == b[3:]
    got.sort(key=lambda r: (str(r[0]), str(r[1:2])))
    want.sort(key=lambda r: (str(r[0]), str(r[1:2])))
    assert len(got) == len(want)
    assert all(close(a, b) for a, b in zip(got, want, strict=True)), [x for x in zip(got, want, strict=True) if not close(*x)][:3]
    named = [(d, x) for d, _, x, _ in docs if x and d is not None and d < 120]
    found = {r[0]: r[1] for r in got}
    assert sum(found[d] == x for d, x in named) / len(named) > 0.9


def test_empty_and_unlabelled(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert identify(spark.createDataFrame([], schema)).count() == 0
    r = identify(spark.createDataFrame([(1, "a b", None, None)], schema)).first()
    assert (r.language, r.rejected) == ("und", False)
    assert K.split_words is not None


def test_texts_in_no_trained_language_are_rejected(spark):
    rng = random.Random(8)
    docs = [(d, " ".join(rng.choice(VOCAB[x]) for _ in range(600)), x, "s") for d, x in enumerate(["en", "en", "en", "de", "fr"] * 40)]
    other = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności",
        "Все люди рождаются свободными и равными в своём достоинстве",
        "人人生而自由 在尊严和权利上一律平等",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan",
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(40)),
        "#*$% &|<> ~~^^ " * 20,
        " ".join(str(rng.randint(0, 99999)) for _ in range(40)),
    ]
    docs += [(1000 + i, t, None, "s") for i, t in enumerate(other)] + [(2000, None, None, "s"), (2001, "", None, "s")]
    got = {r.doc_id: r.rejected for r in identify(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert {d for d, x in got.items() if x} == set(range(1000, 1000 + len(other)))


def test_every_labelled_language_is_trained(spark):
    docs = spark.createDataFrame([(i, f"text{i}", f"l{i:02}") for i in range(70)], "doc_id long, text string, lang string")
    assert train(docs)[0] == [f"l{i:02}" for i in range(70)]

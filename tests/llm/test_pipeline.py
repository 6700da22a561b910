import os
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from sievelight.llm import sentencepiece_sampling as S
from tests.llm.test_language_id import VOCAB
from tests.llm.test_language_id import brute as brute_language
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_near_dedup import brute as brute_near

pytestmark = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no model file")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def strip(rows, size=20):
    first, out = {}, []
    spans = {d: list(re.finditer(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows}
    for d, _ in rows:
        w = [m[0] for m in spans[d]]
        for i in range(len(w) - size + 1):
            first[tuple(w[i : i + size])] = min(first.get(tuple(w[i : i + size]), (d, i)), (d, i))
    for d, t in rows:
        w, gone = [m[0] for m in spans[d]], set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (d, i):
                gone |= set(range(i, i + size))
        if gone:
            ends = [*(m.start() for m in spans[d][1:]), len(t)]
            t = t[: spans[d][0].start()] + "".join(t[m.start() : e] for i, (m, e) in enumerate(zip(spans[d], ends, strict=True)) if i not in gone)
        if not gone or len(gone) < len(w):
            out.append((d, t))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    docs, pages = [], []
    passage = " ".join(f"passage{i}" for i in range(30))
    for d in range(150):
        lang = rng.choice(["en", "de", "fr"])
        text = " ".join(rng.choice(VOCAB[lang]) + (str(rng.randint(0, 99)) if rng.random() < 0.5 else "") for _ in range(rng.randint(20, 120)))
        if d % 10 == 3:
            text += "\n\n" + passage + "  \ntail"
        docs.append((d, text, lang, f"s{d % 4}", len(text)))
        if d % 5 == 0:
            pages.append((d, f"http://h.example.com/{lang}/", f"<html lang={lang}>"))
    docs += [(200 + i, docs[i][1], docs[i][2], "copy", docs[i][4]) for i in range(12)]
    docs += [(300, passage, "en", "s0", 0), (301, "the straße être of und le", None, None, 1), (302, None, "en", "s1", None), (303, "", "en", "s1", 0), docs[4]]
    return docs, pages


def test_stages_and_run(spark, corpus, tmp_path):
    docs, pages = corpus
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    unsure = {r[0] for r in brute_language([r[:4] for r in docs], pages) if r[-1]}
    kept = list({r[:2]: r for r in docs if r[0] not in unsure}.values())
    near = {r[0] for r in brute_near([r[:2] for r in kept], 80) if r[3]}
    want = dict(strip([r[:2] for r in kept if r[0] in near]))
    assert {r.doc_id for r in got} == set(want) and len(got) == len(want)
    assert all(r.lossless for r in got)
    back = {r.doc_id: r.text for r in S.decode_documents(spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id long, ids array<int>")).collect()}
    assert back == want


def test_stages_keep_columns_and_empty_tables(spark, corpus, tmp_path):
    docs, pages = corpus
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for df in (spark.createDataFrame([], COLUMNS), spark.createDataFrame(docs[:20], COLUMNS).selectExpr("1 as TEXT", "*", "1 as id", "2 as tag", "4 as _id", "5 as spans", "6 as _key", "7 as n_left", "8 as mix_pos", "9 as _block")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.schema.names == df.schema.names, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in df.schema], name
            assert out.count() <= df.count()
    mixed = corpus_pipeline.mixture(spark, spark.createDataFrame(docs, COLUMNS), str(tmp_path))
    assert mixed.count() == len(docs)


def test_run_follows_the_schedule(spark, corpus, tmp_path):
    docs, pages = corpus
    spark.createDataFrame(docs, COLUMNS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.doc_id: r.mix_pos for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    source = {d[0]: d[3] for d in docs}
    rows = [(d, source[d]) for d in got]
    weights = {s: n**0.5 for s, n in Counter(s for _, s in rows).items()}
    assert got == {r[0]: r[7] for r in brute_mix(rows, weights, 16, 1000)[0]}


def test_texts_that_share_a_doc_id_stay(spark, corpus, tmp_path):
    docs, _ = corpus
    a, b, long = docs[0][1], docs[1][1], "long words here " * 30000
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, b, "en", "s", 1), (2, b + " x", "en", "s", 1), (3, long, "en", "s", 1), (None, a, "en", "s", 1)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = corpus_pipeline.near_duplicate(spark, df, str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (1, b), (3, long), (None, a)], key=str)
    assert corpus_pipeline.mixture(spark, df, str(tmp_path)).count() == len(rows)

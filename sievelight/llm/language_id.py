"""Language identification by Bayesian evidence fusion.

Log posterior of a language = text log likelihood + weights times the log likelihoods of the declared markup
language and of the address suffix + the log prior of the host.

*   Text: letter 3-grams (bytes of lower-cased words with their edges), hashed to a fixed number of cells,
    with add-half smoothing, trained on a bounded sample of rows that carry a language
    (``max_rows`` per language, drawn by a hash of doc_id).  Every whole text is scored.  Because n-grams of a text
    are dependent, the likelihood is scaled to ``evidence`` effective n-grams at most.
*   Declared language and address suffix (the two-letter first path part, else the top-level domain) of the
    page with the document's id: confusion counts P(declared | language) from grouped counts over all rows, where
    the language is the best one by text alone, with additive smoothing over the kinds of cues seen and one more.
*   Host prior: counts by host, smoothed towards its top-level domain, that towards all rows, each with a
    Dirichlet weight; a document's own text verdict is left out of its host's and domain's counts.  The host is that of the page if there is one, else the document's source.

All of these are grouped aggregations over the whole table; what is broadcast is the n-gram table (its size
is fixed) and the prior tables of suffixes.  Host priors are joined by host, with hot hosts left to AQE.

A document is rejected if its best posterior is below ``least``, or if no trained language explains its (scaled)
text better than a background that gives every cell the same probability; such a text is in none of the
languages, so it does not count for cues and hosts either.  The test is as sharp as the training is large: a
language with few grams gives unseen cells little less than the background does.

Defined results: a null or wordless text has no text evidence, so the other evidence decides, and it is not
rejected for its text; a null doc_id meets no page; a null source is a host of its own; repeated rows are
judged alike; pages that repeat an id count once (smallest url); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import pick, row_key, written

CELLS = 1 << 16


def ngram_cells(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashed 3-grams of every word with a space before and after, and n+1 offsets by text."""
    size = words.end - words.start  # a word of n bytes has n grams
    at = np.append(0, np.cumsum(size + 2))
    first = np.append(0, np.cumsum(size))[words.first]
    if not len(size):
        return np.zeros(0, np.int64), first
    wide = np.full(at[-1], 32, np.uint32)
    wide[K.ranges(at[:-1] + 1, size)] = K.gather(words.data, words.start, words.end)
    code = (wide[:-2] * np.uint32(0x9E3779B1)) ^ (wide[1:-1] * np.uint32(0x85EBCA77)) ^ (wide[2:] * np.uint32(0xC2B2AE3D))
    code = (code * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    keep = np.ones(at[-1], bool)
    keep[at[1:] - 1] = keep[at[1:] - 2] = False
    return code[keep[:-2]].astype(np.int64), first


def _counted(languages: list[str]):
    def run(batches):
        total = np.zeros((len(languages), CELLS), np.int64)
        for batch in batches:
            for part in K.slices(batch, "text"):
                code, first = ngram_cells(K.split_words(part.column("text"), lower=True))
                lang = np.array([languages.index(x) for x in part.column("lang").to_pylist()], np.int64)
                for i in range(len(languages)):
                    mine = np.repeat(lang == i, np.diff(first))
                    total[i] += np.bincount(code[mine], minlength=CELLS)
        row, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[row, cell])], names=["lang", "cell", "n"])

    return run


def train(docs: DataFrame, max_rows: int = 2000) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of each cell, from at most ``max_rows`` labelled rows a language."""
    known = docs.where("lang is not null and lang <> '' and text is not null")
    sizes = known.groupBy("lang").count().collect()  # one row a language
    languages = sorted(r.lang for r in sizes)
    if not languages:
        return ["und"], np.full((1, CELLS), -np.log(CELLS), np.float32)
    share = {r.lang: min(1.0, max_rows / r["count"]) for r in sizes}
    rate = F.create_map(*[F.lit(x) for p in share.items() for x in p])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / (1 << 20)
    sample = known.where(F.col("lang").isin(languages) & (draw < rate[F.col("lang")]))
    cells = sample.select("text", "lang").mapInArrow(_counted(languages), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(languages), CELLS), 0.5)
    table[cells.column("lang").to_numpy(), cells.column("cell").to_numpy()] += cells.column("n").to_numpy()
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _scored(table: np.ndarray):
    cells = np.ascontiguousarray(table.T)

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "text"):
                code, first = ngram_cells(K.split_words(part.column("text"), lower=True))
                seen = cells[code]
                sums = np.stack([K.segment_sum(seen[:, i].astype(np.float64), first) for i in range(cells.shape[1])], axis=1)
                offsets = np.arange(len(first)) * cells.shape[1]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), pa.array(np.diff(first)), K.list_column(sums.ravel(), offsets, pa.float64())], names=[*(c for c in part.schema.names if c != "text"), "grams", "likelihood"])

    return run


def page_evidence(pages: DataFrame) -> DataFrame:
    """``(page_id, declared, suffix, host)`` of each page id."""
    rows = pick(pages, page_id="long", url="string", html="string").where("page_id is not null")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    rest = F.when(F.instr("url", "://") > 0, F.substring(F.col("url"), F.instr("url", "://") + 3, F.length("url")))
    host = F.lower(F.regexp_extract(rest, r"^([^/?#:]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*/([A-Za-z]{2})(?=[/?#]|\z)", 1)
    suffix = F.when(path != "", F.concat(F.lit("/"), F.lower(path))).otherwise(F.element_at(F.split(host, r"\."), -1))
    rows = rows.select("page_id", "url", F.nullif(declared, F.lit("")).alias("declared"), F.nullif(suffix, F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"))
    return rows.groupBy("page_id").agg(F.min_by(F.struct("declared", "suffix", "host"), F.coalesce("url", F.lit(""))).alias("e")).select("page_id", "e.*")


def identify(docs: DataFrame, pages: DataFrame | None = None, max_rows: int = 2000, evidence: float = 40.0, least: float = 0.5, trust: float = 0.5, smooth: float = 20.0, keyed: bool = False) -> DataFrame:
    """``(doc_id, language, posterior, text_language, declared, suffix, host, rejected)`` for every row of ``docs(doc_id, text, lang, source)``.

    With ``keyed`` comes also ``row_key`` (see :func:`.common.row_key`), which tells different texts of one doc_id apart.
    """
    rows = pick(docs, doc_id="long", text="string", lang="string", source="string").withColumn("row_key", row_key())
    languages, table = train(rows, max_rows)
    k = len(languages)
    scored = rows.drop("lang").mapInArrow(_scored(table), "doc_id long, source string, row_key long, grams long, likelihood array<double>")
    if pages is not None:
        scored = scored.join(page_evidence(pages), F.col("doc_id") == F.col("page_id"), "left").drop("page_id")
    else:
        scored = scored.withColumns({c: F.lit(None).cast("string") for c in ("declared", "suffix", "host")})
    scale = F.when(F.col("grams") > evidence, F.lit(evidence) / F.col("grams")).otherwise(F.lit(1.0))
    scored = scored.withColumn("text_log", F.transform("likelihood", lambda x: x * scale))
    unknown = F.array_max("text_log") < F.col("grams") * scale * -float(np.log(CELLS)) - 1e-4
    best = F.array_position("text_log", F.array_max("text_log")).cast("int") - 1
    host = F.coalesce("host", F.concat(F.lit("source:"), F.coalesce("source", F.lit("?"))))
    scored = written(scored.withColumns({"best": F.when(F.col("grams") > 0, best), "unknown": unknown, "host": host, "zone": F.element_at(F.split(host, r"\."), -1)}).drop("likelihood"))
    sure = scored.where("best is not null and not unknown")
    # P(cue | language): how often a language's documents carry the cue
    cue, unseen = {}, {}
    for name in ("declared", "suffix"):
        counts = written(sure.where(F.col(name).isNotNull()).groupBy(name, "best").agg(F.count("*").alias("n")))
        kinds = counts.select(name).distinct().count()
        totals = {r.best: r.n for r in counts.groupBy("best").agg(F.sum("n").alias("n")).collect()}  # one row a language
        of_language = F.array(*[F.lit(float(totals.get(i, 0) + kinds + 1)) for i in range(k)])
        shares = counts.select(name, "best", F.log((F.col("n") + 1.0) / F.get(of_language, F.col("best"))).alias("log"))
        cue[name] = shares.groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct("best", "log"))).alias(f"{name}_logs"))
        unseen[name] = [-float(np.log(totals.get(i, 0) + kinds + 1)) for i in range(k)]
    # host priors: host -> zone -> all rows
    total = sure.groupBy("best").agg(F.count("*").alias("n")).collect()  # one row a language
    everywhere = np.full(k, 1.0)
    for r in total:
        everywhere[r.best] += r.n
    everywhere = (everywhere / everywhere.sum()).tolist()
    tally = lambda key: sure.groupBy(key).agg(*[F.sum((F.col("best") == i).cast("double")).alias(f"{key}_{i}") for i in range(k)], F.count("*").cast("double").alias(f"{key}_n"))
    zones, hosts = tally("zone"), tally("host")
    zones = zones.select("zone", F.array(*[F.col(f"zone_{i}") for i in range(k)]).alias("zone_count"), "zone_n")
    hosts = hosts.select("host", F.array(*[F.col(f"host_{i}") for i in range(k)]).alias("host_count"), "host_n")
    out = scored.join(hosts, "host", "left").join(zones, "zone", "left")
    for name, logs in cue.items():
        out = out.join(logs, name, "left")
    counted = F.col("best").isNotNull() & ~F.col("unknown")  # then its own verdict is among the counts

    def posterior(i: int):
        self_n, self_i = counted.cast("double"), (counted & (F.col("best") == i)).cast("double")
        less = lambda count, own: F.coalesce(count - own, F.lit(0.0))
        zone = (less(F.get("zone_count", F.lit(i)), self_i) + smooth * everywhere[i]) / (less(F.col("zone_n"), self_n) + smooth)
        prior = F.log((less(F.get("host_count", F.lit(i)), self_i) + smooth * zone) / (less(F.col("host_n"), self_n) + smooth))
        value = F.element_at("text_log", i + 1) + prior
        for name in cue:
            there = F.col(f"{name}_logs").isNotNull()
            value = value + F.when(there, trust * F.coalesce(F.element_at(f"{name}_logs", F.lit(i)), F.lit(unseen[name][i]))).otherwise(0.0)
        return value

    out = out.withColumn("logs", F.array(*[posterior(i) for i in range(k)]))
    top = F.array_max("logs")
    name = F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position("logs", top).cast("int"))
    text_name = F.when(F.col("best").isNotNull(), F.element_at(F.array(*[F.lit(x) for x in languages]), F.col("best") + 1))
    sure_of = 1.0 / F.aggregate(F.transform("logs", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, b: a + b)
    out = out.select("doc_id", name.alias("language"), sure_of.alias("posterior"), text_name.alias("text_language"), "declared", "suffix", "host", "unknown", "row_key")
    return out.select("doc_id", "language", "posterior", "text_language", "declared", "suffix", "host", (F.col("unknown") | (F.col("posterior") < least)).alias("rejected"), *(["row_key"] if keyed else []))

"""Heuristic quality rules with cross-document line frequency.

Per document: base measures (see :func:`judge`).  Across documents: every line is normalised (its words, A-Z
lower-cased, joined by one space) and hashed to 64 bits; for each host the distinct documents with the line
are counted; a document is a doc_id with a text, so repeated rows count once, and copies under other ids each.  A line in more than
``max(min_docs, share * documents of the host)`` of a host's documents is removed there, and a document that keeps less than ``keep``
of its words is rejected.  Lines are taken from distinct (host, text) pairs, each weighing as many documents as have it, with
partial sums before each shuffle, so neither a hot host, line nor group of copies gathers in one task.

Defined results: null or empty text has no words and fails the base rules; a null host is a host of its own;
repeated rows are judged alike and all returned; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import pick, written

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
ROWS = f"doc_id long, host string, low long, high long, {MEASURES}, lines array<long>, line_words array<long>"


def _repeat_words(words: K.Words, hashes: np.ndarray, n: int = 3) -> np.ndarray:
    """Per text, the words that stand in an n-word window found twice or more in that text."""
    key, at = K.windows(words, hashes, n)
    if not len(at):
        return np.zeros(len(words.first) - 1, np.int64)
    both = key ^ K.mix64(words.text[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(both)
    same = both[order[1:]] == both[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + n, -1)
    return K.segment_sum((np.cumsum(step[:-1]) > 0).astype(np.int64), words.first)


def _measured(batches):
    for batch in batches:
        for part in K.slices(batch, "text"):
            n = part.num_rows
            words = K.split_words(part.column("text"))
            hashes = words.hashes()
            data, offsets = words.data, words.offsets
            low = K._LOWER[data]
            inside = np.zeros(len(data) + 1, np.int64)
            np.add.at(inside, words.start, 1)
            np.add.at(inside, words.end, -1)
            lead = ((data & 0xC0) != 0x80) & (np.cumsum(inside[:-1]) > 0)
            # lines: cut after every newline and at every text's end
            feed = np.flatnonzero(data == 10)
            text = np.searchsorted(offsets, feed, "right") - 1
            begin = np.concatenate([offsets[:-1], feed + 1])
            stop = np.concatenate([offsets[1:], feed])
            owner = np.concatenate([np.arange(n), text])
            order = np.lexsort((begin, owner))
            begin, owner = begin[order], owner[order]
            stop = np.append(begin[1:] - 1, 0)
            last = np.append(owner[1:] != owner[:-1], True) if n else np.zeros(0, bool)
            stop[last] = offsets[1:][owner[last]]
            w0, w1 = np.searchsorted(words.start, begin), np.searchsorted(words.start, stop)
            full = w1 > w0
            begin, stop, owner, w0, w1 = begin[full], stop[full], owner[full], w0[full], w1[full]
            raw, count, first = K.unique_per_text(K.range_hash(data, begin, stop), owner, n)
            again = K.segment_sum(count - 1, first)
            # normalised lines
            norm = K.range_hash(low, words.start, words.end)
            power, inverse = K.powers(K.WORD_BASES[0], len(norm) + 1)
            total = np.zeros(len(norm) + 1, np.uint64)
            np.cumsum(norm * power[: len(norm)], out=total[1:])
            line = K.mix64((total[w1] - total[w0]) * inverse[w0])
            key, count, first = K.unique_per_text(line, owner, n)
            # all copies of a line in one text have the same number of words
            size = np.zeros(len(key), np.int64)
            if len(key):
                where = np.lexsort((line, owner))
                size = (w1 - w0)[where][np.append(0, np.cumsum(count))[:-1]] * count
            ends = offsets[1:]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("host"),
                    pa.array(K.range_hash(data, offsets[:-1], ends).view(np.int64)),
                    pa.array(K.range_hash(data, offsets[:-1], ends, K.BASES[1]).view(np.int64)),
                    pa.array(words.count),
                    pa.array(K.segment_sum(lead.astype(np.int64), offsets)),
                    pa.array(K.segment_sum(_SYMBOL[data].astype(np.int64), offsets)),
                    pa.array(again),
                    pa.array(_repeat_words(words, hashes)),
                    K.list_column(key.view(np.int64), first, pa.int64()),
                    K.list_column(size, first, pa.int64()),
                ],
                names=["doc_id", "host", "low", "high", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
            )


def judge(docs: DataFrame, min_docs: int = 20, share: float = 0.05, keep: float = 0.5) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_line_words_removed)``.

    For every row of ``docs(doc_id, text, source)``, source being the host.  Base rules: at least 50 words, and
    at most half of the words in 3-word windows that the text holds twice.
    """
    docs = pick(docs, doc_id="long", text="string", source="string").withColumnRenamed("source", "host")
    rows = written(docs.mapInArrow(_measured, ROWS))
    host = F.coalesce(F.concat(F.lit("h"), "host"), F.lit("n")).alias("h")
    copies = rows.select(host, "low", "high", "doc_id").distinct().groupBy("h", "low", "high").agg(F.count("*").alias("docs"))
    texts = rows.select(host, "low", "high", "lines", "line_words").dropDuplicates(["h", "low", "high"]).join(copies, ["h", "low", "high"])
    lines = written(texts.select("h", "low", "high", "docs", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("h", "low", "high", "docs", "l.lines", "l.line_words"))
    hosts = copies.groupBy("h").agg(F.sum("docs").alias("all_docs"))
    common = lines.groupBy("h", "lines").agg(F.sum("docs").alias("n")).where(F.col("n") > min_docs).join(hosts, "h").where(F.col("n") > F.col("all_docs") * share).select("h", "lines")
    cut = lines.join(written(common), ["h", "lines"]).groupBy("h", "low", "high").agg(F.sum("line_words").alias("gone"))
    cut = cut.select(F.col("h").alias("_h"), F.col("low").alias("_low"), F.col("high").alias("_high"), "gone")
    same = (F.coalesce(F.concat(F.lit("h"), "host"), F.lit("n")) == F.col("_h")) & (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high"))
    out = rows.drop("lines", "line_words").join(cut, same, "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("n_words") - F.col("gone") >= F.col("n_words") * keep)).alias("kept"), F.col("gone").alias("n_line_words_removed"))

"""The scan plan: prepared documents, raw findings, then enrichment, correlation, suppression, threshold, order.

Everything up to the findings' rows is narrow: spans, lines and ignore markers stay arrays of their document, so
there is no interval or as-of join.  Only the join with a baseline and the final sort exchange rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guard import attempt
from ..functions.regex import WIDE
from ..functions.shared import small_batches, written
from ..functions.text import fingerprint, line_window, narrow, take, truncate, visualize
from ..operators.detectors import RULES, agent_file
from ..operators.matching import PLACE, located, scanned
from ..operators.model import RAWS, Document, Match, Pattern, Rule, bump, raw, severity_name, severity_rank
from ..operators.prose import kinds_of_files, spans_of

# Limits of the report and of correlation.
SNIPPET, CONTEXT = 160, 200
FAMILIES_TO_BOOST = 3
MOST_PER_RULE = 50
MARKER = "scan-ignore"
FINDING = ("rule_id", "rule_title", "family", "severity", "base_severity", "file", "line", "column", "snippet", "context", "message", "fingerprint", "boosted_by", "detail")
ORDER = ("rule_ord", "match_ord")
TAGGED = "array<struct<rule_ord: int, idx: int, match: string, severity: int, message: string, detail: string>>"
KEPT = TAGGED[:-2] + ", match_ord: int>>"
OVER = "array<struct<rule_ord: int, n: int>>"


@dataclass
class Scan:
    """Results of a scan: findings at or above the threshold, suppressed ones, errors, and files scanned."""

    findings: DataFrame
    suppressed: DataFrame
    errors: DataFrame
    files: DataFrame

    def stats(self) -> DataFrame:
        return self.files.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes_scanned"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later filters and projections read but never repeat: a generator ends the optimiser's inlining."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _of(values: list, k: Column) -> Column:
    """The k-th of some constants; they go to Spark as one literal each, not element by element."""
    if any(isinstance(v, str) for v in values):
        return F.get(F.split(F.lit("\x01".join(v or "" for v in values)), "\x01"), k)
    return F.get(F.expr(f"array({', '.join('null' if v is None else str(v) for v in values)})"), k)


def _by_function(listed: list[Pattern], attribute: str, k: Column, m: Match, otherwise: Column) -> Column:
    """One branch for each distinct function among the patterns."""
    users: dict = {}
    for n, p in enumerate(listed):
        if getattr(p, attribute):
            users.setdefault(getattr(p, attribute), []).append(n)
    out = None
    for f, numbers in users.items():
        mine = k.isin(numbers) if len(numbers) > 1 else k == numbers[0]
        out = F.when(mine, f(m)) if out is None else out.when(mine, f(m))
    return otherwise if out is None else out.otherwise(otherwise)


def _called(rules: list[Rule]):
    """Runs the Python rules on each text; what a rule raises becomes an error of that file."""
    mine = [(i, r) for i, r in enumerate(rules) if r.call]

    def run(path: pd.Series, text: pd.Series) -> pd.DataFrame:
        out = []
        for p, t in zip(path, text, strict=True):
            found, failed = [], []
            for i, r in mine:
                try:
                    found += [(i, *x) for x in r.call(p, t)]
                except Exception as e:  # a rule that fails must not silence the others, nor itself
                    failed.append(f"rule {r.id} failed on this file, which it did not check: {e}")
            out.append(([list(x) for x in zip(*found, strict=True)] or [[]] * 5, failed))
        return pd.DataFrame([(*columns, failed) for columns, failed in out], columns=["rule_ord", "idx", "match", "severity", "message", "failed"])

    return F.pandas_udf(run, "rule_ord array<int>, idx array<int>, match array<string>, severity array<int>, message array<string>, failed array<string>")


_BUILT: dict = {}


def _kept(name: tuple | str, rules: list[Rule], make):
    """What ``make`` gives, made once in a session for the same rules: columns hold names, not tables, and building large ones takes seconds."""
    key = (SparkSession.active().sparkContext.applicationId, name, tuple(rules))
    if key not in _BUILT:
        if len(_BUILT) > 200:  # of rules made anew again and again
            _BUILT.clear()
        _BUILT[key] = make()
    return _BUILT[key]


def _failure(rule_id: Column, why: Column) -> Column:
    return F.concat(F.lit("rule "), rule_id, F.lit(" failed on this file, which it did not check: "), why)


def raw_findings(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per document with a finding or an error: ``path, text, agent_file, raw`` (each rule's first 50, in order),
    ``over`` (rules with more, and how many) and ``failed`` (messages).

    One pass over a text finds the hits of all patterns (:mod:`..operators.matching`); only texts with some go on.  Their hits go through one
    confirmation and one report for each kind of pattern, and one sweep, so the plan grows with the kinds, not with the patterns.
    """
    rules = RULES if rules is None else rules
    doc = Document(F.col("path"), F.col("rule_text"), F.col("spans"), F.col("whole"), F.col("agent_file"))
    listed = [(i, p) for i, r in enumerate(rules) for p in r.patterns]
    patterns = [p for _, p in listed]
    none = F.array().cast("array<string>")
    own = [(i, r) for i, r in enumerate(rules) if r.scan]
    small_batches(files.sparkSession)
    docs = kinds_of_files(files.where("text is not null and path is not null"))
    specs = tuple((p.java, p.gate, p.needles, p.foreign, p.first_only, p.near) for p in patterns)
    # one worker lexes and matches; only rules with an expression of their own need what the lexer finds
    docs = docs.withColumn("m", scanned(specs, F.col("text"), F.col("family"), any(r.scan is not agent_file for _, r in own)))
    docs = docs.select("path", "text", F.coalesce("m.text", "text").alias("rule_text"), spans_of(doc.whole, F.col("text"), F.col("m.spans")).alias("spans"), "whole", "agent_file", "m")
    if any(r.call for r in rules):
        docs = docs.withColumn("called", _called(rules)(doc.path, doc.text))
    elif not own or all(r.scan is agent_file for _, r in own):
        docs = docs.where((F.size("m.hits") > 0) | (F.size("m.failed") > 0) | (doc.agent_file if own else F.lit(False)))
    rule_of = lambda k: _of([i for i, _ in listed], k)

    sources = []
    if listed:
        def as_match(h):
            k = h["k"]
            return Match(h["idx"], h["match"], h["near"], h["lead"], h["after"], h["lead_after"], h["prose"], doc.whole, _of([p.java for p in patterns], k), _of([p.label for p in patterns], k))

        def confirmed(h):
            return (_of([p.anywhere for p in patterns], h["k"]) | h["prose"]) & _by_function(patterns, "confirm", h["k"], as_match(h), F.lit(True))

        def reported(h):
            plain = raw(h["idx"], h["match"], _of([p.severity for p in patterns], h["k"]).cast("int"))
            return F.struct(rule_of(h["k"]).alias("rule"), _by_function(patterns, "report", h["k"], as_match(h), plain).alias("x"))

        # a rule of which a pattern failed has no findings in that file, but an error
        broken = F.array_distinct(F.transform("m.failed", lambda f: rule_of(f["k"])))
        docs = docs.withColumn("why", F.when(F.size("m.failed") > 0, F.transform(broken, lambda i: _failure(_of([r.id for r in rules], i), F.filter("m.failed", lambda f: rule_of(f["k"]) == i)[0]["why"]))).otherwise(none))
        whole_rules = lambda: F.when(F.size("m.failed") > 0, F.filter("m.hits", lambda h: ~F.array_contains(broken, rule_of(h["k"])))).otherwise(F.col("m.hits"))
        docs = _once(docs, "fine", _kept("fine", rules, lambda: F.filter(whole_rules(), confirmed)))
        sources.append(_kept("reported", rules, lambda: F.transform(F.filter(F.transform("fine", reported), lambda r: r["x"].isNotNull()), lambda r: _tagged(r["rule"], r["x"]))))
    else:
        docs = docs.withColumn("why", none)
    for i, r in own:
        if r.scan is agent_file:
            sources.append(_numbered(i, r.scan(doc)))
            continue
        # an expression that raises in a row is an error of its rule there, and nothing else fails
        docs = _once(docs, f"own_{i}", attempt(F.coalesce(r.scan(doc).cast(RAWS), F.array().cast(RAWS))))
        sources.append(_numbered(i, F.coalesce(f"own_{i}", F.array().cast(RAWS))))
        docs = docs.withColumn("why", F.when(F.col(f"own_{i}").isNull(), F.concat("why", F.array(_failure(F.lit(r.id), F.lit("its expression raised an error"))))).otherwise(F.col("why")))
    failed = F.col("why")
    if any(r.call for r in rules):
        c = F.col("called")
        rows = F.sequence(F.lit(1), F.size(c["idx"]))
        at = lambda name, j: F.element_at(c[name], j)
        made = F.transform(rows, lambda j: _tagged(at("rule_ord", j), raw(at("idx", j), at("match", j), at("severity", j), at("message", j))))
        sources.append(F.when(F.size(c["idx"]) > 0, made).otherwise(F.array().cast(TAGGED)))
        failed = F.concat(failed, c["failed"])
    docs = _once(docs.withColumn("failed", failed), "found", F.concat(*sources) if sources else F.array().cast(TAGGED))
    # rules in order; within a deduplicated rule by offset and length, else as produced
    swept = [r.dedupe for r in rules]
    key = lambda x, j: F.struct(x["rule_ord"].alias("rule"), F.when(_of(swept, x["rule_ord"]), x["idx"]).otherwise(0).alias("a"), F.when(_of(swept, x["rule_ord"]), -F.length(x["match"])).otherwise(0).alias("b"), j.alias("j"), x.alias("x"))
    start = F.struct(F.lit(-1).alias("rule"), F.lit(0).alias("to"), F.lit(0).alias("n"), F.array().cast(KEPT).alias("out"), F.array().cast(OVER).alias("over"))
    more = lambda acc: F.when(acc["n"] > MOST_PER_RULE, F.concat(acc["over"], F.array(F.struct(acc["rule"].alias("rule_ord"), acc["n"].alias("n"))))).otherwise(acc["over"])

    def sweep(acc, e):
        x, same = e["x"], acc["rule"] == e["rule"]
        n = F.when(same, acc["n"]).otherwise(0)
        fits = ~(same & _of(swept, e["rule"]) & (e["a"] < acc["to"]))
        one = F.array(F.struct(*[x[c].alias(c) for c in ("rule_ord", "idx", "match", "severity", "message", "detail")], n.alias("match_ord")))
        return F.struct(e["rule"].alias("rule"), F.when(fits, e["a"] - e["b"]).otherwise(acc["to"]).alias("to"), F.when(fits, n + 1).otherwise(n).alias("n"), F.when(fits & (n < MOST_PER_RULE), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"), F.when(same, acc["over"]).otherwise(more(acc)).alias("over"))

    done = lambda: F.aggregate(F.array_sort(F.transform("found", key)), start, sweep, lambda acc: F.struct(acc["out"].alias("raw"), more(acc).alias("over")))
    return _once(docs, "swept", _kept("swept", rules, done)).select("path", "text", "agent_file", "swept.raw", "swept.over", "failed")


def _numbered(i: int, found: Column) -> Column:
    return F.transform(found.cast(RAWS), lambda x: _tagged(F.lit(i), x))


def _tagged(rule: Column, x: Column) -> Column:
    return F.struct(rule.cast("int").alias("rule_ord"), *[x[c].alias(c) for c in ("idx", "match", "severity", "message", "detail")])


def marker_pattern(marker: str = MARKER) -> str:
    """An ignore marker and what it names, in the Java dialect."""
    ws = rf"[\s{WIDE}]"
    return rf"{marker}(-next-line)?(?:{ws}*[: ]{ws}*([A-Za-z0-9/_,\s{WIDE}-]+))?"


def ignored_inline(own: Column, above: Column, rule_id: Column, marker: str = MARKER) -> Column:
    """Whether ignore markers cover a finding of a rule, given the markers (if any) of its line and of the one above.

    A marker covers its own line, with ``-next-line`` the one below; rule ids (words with a slash) behind it narrow it.  A bare marker
    on the line itself covers everything; otherwise the lists of both markers add up.
    """
    pattern = marker_pattern(marker)
    ids = lambda x: F.filter(F.split(F.regexp_extract(x, pattern, 2), rf"[,\s{WIDE}]+"), lambda i: i.contains("/"))
    here = own.isNotNull() & (F.regexp_extract(own, pattern, 1) == "")
    before = above.isNotNull() & (F.regexp_extract(above, pattern, 1) != "")
    mine, theirs = ids(own), ids(above)
    listed = F.when(before, F.array_contains(theirs, rule_id)).otherwise(F.lit(False))
    return F.when(here & (F.size(mine) == 0), True).when(here, F.array_contains(mine, rule_id) | listed).when(before, (F.size(theirs) == 0) | listed).otherwise(False)


def enrich(found: DataFrame, rules: list[Rule] | None = None, boost: bool = True, marker: str = MARKER) -> DataFrame:
    """Findings with all their columns, ``rank`` and ``ignored``; and rows that have only ``file`` and ``error``."""
    rules = RULES if rules is None else rules
    of = lambda attribute, k: _of([getattr(r, attribute) for r in rules], k)
    kinds = F.size(F.array_distinct(F.transform("raw", lambda x: of("family", x["rule_ord"]))))
    over = F.transform("over", lambda o: F.concat(F.lit("rule "), of("id", o["rule_ord"]), F.lit(" matched "), o["n"].cast("string"), F.lit(f" times; only the first {MOST_PER_RULE} are reported")))
    # places are found while the text is one row; rows of findings carry windows of it only
    found = found.withColumn("places", located(F.col("text"), F.col("raw.idx"), CONTEXT, marker_pattern(marker)))
    one = F.zip_with("raw", "places", lambda x, p: F.struct(x.alias("f"), p.alias("p"), F.lit(None).cast("string").alias("error")))
    bad = F.transform(F.concat(over, "failed"), lambda e: F.struct(F.lit(None).cast(KEPT[6:-1]).alias("f"), F.lit(None).cast(PLACE).alias("p"), e.alias("error")))
    rows = found.select("path", "agent_file", kinds.alias("kinds"), F.explode_outer(F.concat(one, bad)).alias("e")).where("e is not null")
    rows = rows.select("path", "agent_file", "kinds", "e.f", "e.p", "e.error")
    rule = F.col("f.rule_ord")
    first = lambda: [
        F.col("path").alias("file"), "agent_file", "kinds", "error", of("id", rule).alias("rule_id"), of("title", rule).alias("rule_title"), of("family", rule).alias("family"),
        F.coalesce("f.severity", of("severity", rule)).alias("base"), "p.line", "p.column", "p.own", "p.above",
        visualize(take(F.col("f.match"), SNIPPET)).alias("shown"), narrow(line_window(F.col("p.left"), F.col("p.behind"), CONTEXT)).alias("window"), F.coalesce("f.message", of("message", rule)).alias("message"),
        "f.detail", "f.rule_ord", "f.match_ord", fingerprint(of("id", rule), F.col("path"), F.col("f.match")).alias("fingerprint"),
    ]
    rows = rows.select(*_kept("first", rules, first))
    raises = (F.col("family") != "agent-config") if boost else F.lit(False)
    many, auto = raises & (F.col("kinds") >= FAMILIES_TO_BOOST), raises & F.col("agent_file")
    rank = bump(F.col("base"), many.cast("int") + auto.cast("int"))
    why = F.concat_ws("; ", F.when(many, F.concat(F.col("kinds").cast("string"), F.lit(" distinct techniques in this file"))), F.when(auto, "agents load this file by themselves"))
    # each step is a projection of its own, so that no long expression is repeated inside another
    rows = rows.withColumns({"window": _kept("window", rules, lambda: visualize(F.regexp_replace("window", rf"^[\s{WIDE}]+|[\s{WIDE}]+\z", ""))), "rank": rank, "why": why})
    last = lambda: [
        "rule_id", "rule_title", "family", severity_name(F.col("rank")).alias("severity"), severity_name(F.col("base")).alias("base_severity"), "file", "line", "column",
        truncate(F.col("shown"), SNIPPET).alias("snippet"), truncate(F.col("window"), CONTEXT).alias("context"), "message", "fingerprint", F.nullif("why", F.lit("")).alias("boosted_by"), "detail", *ORDER,
        "rank", F.when(F.col("own").isNotNull() | F.col("above").isNotNull(), ignored_inline(F.col("own"), F.col("above"), F.col("rule_id"), marker)).otherwise(F.lit(False)).alias("ignored"), "error",
    ]
    return rows.select(*_kept(("last", marker), rules, last))


def allowed(patterns: list[str]) -> Column:
    """Whether an allow pattern (case-insensitive) is in the snippet or the context."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.col("snippet").rlike(f"(?i){p}") | F.col("context").rlike(f"(?i){p}")
    return out


def in_order(findings: DataFrame, limit: int = 0) -> DataFrame:
    """Most severe first, then by file (in collation order), line, column, rule and match; at most ``limit`` if given.

    A global sort reads its input twice: give it stored rows.
    """
    out = findings.orderBy(F.col("rank").desc(), F.collate("file", "UNICODE"), "file", "line", "column", *ORDER)
    return out.limit(limit) if limit else out


def judge(rows: DataFrame, files: DataFrame, baseline: DataFrame | None = None, allow: list[str] | None = None, min_severity: str = "info", max_findings: int = 0) -> Scan:
    """Splits the rows of :func:`enrich` into findings at or above the threshold, suppressed ones, and errors."""
    errors = rows.where("error is not null").select("file", F.col("error").alias("message"))
    rows = rows.where("error is null")
    hidden = F.col("ignored") | allowed(allow or [])
    if baseline is not None:
        known = baseline.select(F.col("fingerprint").alias("_known")).dropDuplicates()
        rows = rows.join(known, F.col("fingerprint") == F.col("_known"), "left")
        hidden = hidden | F.col("_known").isNotNull()
    rows = rows.withColumn("hidden", hidden)
    columns = [*FINDING, *ORDER, "rank"]
    kept = rows.where(~F.col("hidden") & (F.col("rank") >= severity_rank(min_severity))).select(*columns)
    return Scan(in_order(kept, max_findings), in_order(rows.where("hidden").select(*columns)), errors, files)


def scan(files: DataFrame, rules: list[Rule] | None = None, baseline: DataFrame | None = None, allow: list[str] | None = None, min_severity: str = "info", boost: bool = True, max_findings: int = 0, marker: str = MARKER, store: bool = True) -> Scan:
    """Scans ``files(path, text)``.  ``baseline(fingerprint)`` holds accepted findings.

    With ``store`` the scan runs here, once, and its rows go to the shared folder; all results derive from that table.
    """
    rows = enrich(raw_findings(files, rules), rules, boost, marker)
    return judge(written(rows) if store else rows, files, baseline, allow, min_severity, max_findings)


def scan_text(spark: SparkSession, text: str, path: str, **options) -> Scan:
    """Scans one text, as :func:`scan` does a table of them."""
    return scan(spark.createDataFrame([(path, text)], "path string, text string"), **options)

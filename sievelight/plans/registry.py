"""Registered queries of the scanner over the supplied tables, and the SQL that checks them.

Match queries return one row per match of every pattern of a rule, with its exact offset, over all seeded documents.  Scan queries
run the whole plan (lexer, gates, confirmation, deduplication, correlation, suppression, order).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import GlobSet
from ..functions.regex import java, matches, needles, worth
from ..functions.shared import shared_dir, written
from ..functions.text import column_of, fingerprint, line_of
from ..operators import detectors as D
from ..operators.model import RAWS, SEVERITIES, Rule, raw
from ..operators.patterns import PATTERNS
from ..operators.prose import AGENT_FILES, AGENT_FOLDERS, BASENAMES, EXTENSIONS, family_of, is_agent_file, prepare
from ..sinks import baselines
from ..sources.files import DEFAULT_EXCLUDES
from ..sources.tables import quoted, seeded, seeded_sql
from . import proof
from .report import compact_lines, github_lines, severity_counts
from .scan import enrich, judge, raw_findings, scan
from .table_function import register

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Patterns per query as (name, pattern, flags); the second form is for engines with RE2 where it differs.
_CASED = {("injection/role-marker", 1), ("injection/role-marker", 2), ("injection/role-marker", 5), ("injection/exfiltration", 4), ("concealment/markdown-metadata", 2), ("concealment/markdown-metadata", 3)}
_RULE_QUERIES = {
    "instruction_overrides": "injection/instruction-override", "role_markers": "injection/role-marker", "trust_assertions": "injection/trust-assertion",
    "agent_targeting": "injection/agent-targeting", "exfiltration": "injection/exfiltration", "tool_abuse": "injection/tool-abuse", "markdown_metadata": "concealment/markdown-metadata",
}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _there(groups: tuple[tuple[str, ...], ...]) -> Column:
    """Whether the lower-cased text has a literal of each group, the rarest group first; a pattern matches in no other text."""
    out = F.lit(True)
    for group in sorted(groups, key=worth, reverse=True):
        out = out & reduce(or_, [F.col("low").contains(word) for word in group])
    return out


def _hits(patterns: list[tuple[int, str, tuple]]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = seeded(spark, sf_dir).withColumn("low", F.lower("text"))
        none = F.array().cast("array<struct<pattern: int, idx: int, match: string>>")
        found = F.concat(*[F.when(_there(groups) & F.col("text").rlike(p), _tagged(p, n)).otherwise(none) for n, p, groups in patterns])
        return docs.select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.pattern", "m.idx", "m.match")

    return run


def _tagged(pattern: str, number: int):
    return F.transform(matches(F.col("text"), F.lit(pattern)), lambda m: F.struct(F.lit(number).alias("pattern"), m["idx"].alias("idx"), m["match"].alias("match")))


def _hits_sql(patterns: list[tuple[int, str, str]]) -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, {n} AS pattern, string_split_regex(text, {quoted(p)}{options}) AS seg, regexp_extract_all(text, {quoted(p)}, 0{options}) AS m FROM seeded" for n, p, flags in patterns for options in [", 'i'" if "i" in flags else ""])
    return f"""WITH seeded AS ({seeded_sql()}), found AS ({each}),
    numbered AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM found WHERE len(m) > 0)
    SELECT doc_id, pattern,
      CAST(list_sum(list_transform(seg[1:k], lambda s: length(s))) + CASE WHEN k > 1 THEN list_sum(list_transform(m[1:k - 1], lambda s: length(s))) ELSE 0 END AS INTEGER) AS idx,
      m[k] AS match
    FROM numbered"""


def _matching(name: str, patterns: list[tuple[int, str, str]], java_forms: dict[int, str] | None = None, literals: bool = False) -> None:
    forms = java_forms or {}
    run = _hits([(n, forms.get(n, java(p, flags)), needles(p) if literals else ()) for n, p, flags in patterns])
    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = _hits_sql([(n, ("(?m)" if "m" in flags else "") + p, flags) for n, p, flags in patterns])


for _name, _rule in _RULE_QUERIES.items():
    # the label pattern has a lookahead; here it takes the character behind instead
    _list = [(n, p.replace(r"[ \t]*(?=\S)", r"[ \t]*\S"), "" if (_rule, n) in _CASED else "im" if p.startswith("^") else "i") for n, p in enumerate(PATTERNS[_rule], 1)]
    _matching(_name, _list, literals=True)
_matching("tag_runs", [(1, r"[\x{E0000}-\x{E007F}]+", "")], {1: D.TAGS.java})
_matching("variation_selector_runs", [(1, r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]{3,}", "")], {1: D.SELECTORS.java})
_matching("invisible_runs", [(1, D._class(D.INVISIBLE) + "+", "")], {1: D.ZERO_WIDTH.java})
_matching("bidi_characters", [(1, D._class(D.BIDI), "")], {1: D._class(D.BIDI)})
_matching("control_runs", [(1, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+", "")], {1: r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+"})
_matching("base64_candidates", [(1, D.BASE64, "")])
_matching("escape_runs", [(n, p, "") for n, p in enumerate(D.ESCAPES.values(), 1)])
_matching("decode_and_execute", [(1, D.DECODE_THEN_RUN, "i"), (2, D.RUN_THEN_DECODE, "i")])
_matching("horizontal_padding", [(1, D.HORIZONTAL, "m")])
_matching("vertical_padding", [(1, D.VERTICAL, "")])


@query
def located_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line, column and fingerprint of the first override pattern's matches."""
    p = java(PATTERNS["injection/instruction-override"][0], "i")
    rows = seeded(spark, sf_dir).where(F.col("text").rlike(p)).select("doc_id", "path", "text", F.explode(matches(F.col("text"), p)).alias("m"))
    return rows.select("doc_id", "path", line_of(F.col("text"), F.col("m.idx")).cast("long").alias("line"), column_of(F.col("text"), F.col("m.idx")).cast("long").alias("column"), fingerprint(F.lit("injection/instruction-override"), F.col("path"), F.col("m.match")).alias("fingerprint"))


_FIRST = quoted(PATTERNS["injection/instruction-override"][0])
ORACLE_SQL["located_overrides"] = f"""WITH seeded AS ({seeded_sql()}),
found AS (SELECT doc_id, path, text, string_split_regex(text, {_FIRST}, 'i') AS seg, regexp_extract_all(text, {_FIRST}, 0, 'i') AS m FROM seeded),
numbered AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM found WHERE len(m) > 0),
heads AS (SELECT *, substr(text, 1, CAST(list_sum(list_transform(seg[1:k], lambda s: length(s))) + CASE WHEN k > 1 THEN list_sum(list_transform(m[1:k - 1], lambda s: length(s))) ELSE 0 END AS BIGINT)) AS head FROM numbered)
SELECT doc_id, path, length(head) - length(replace(head, chr(10), '')) + 1 AS line, length(regexp_extract(head, '[^\\n]*$')) + 1 AS "column",
  substr(sha256('injection/instruction-override' || chr(0) || path || chr(0) || lower(trim(regexp_replace(m[k], '\\s+', ' ', 'g')))), 1, 16) AS fingerprint
FROM heads"""


@query
def language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes by language family and agent-file flag."""
    rows = seeded(spark, sf_dir).select(family_of(F.col("path")).alias("family"), is_agent_file(F.col("path")).alias("agent_file"), F.octet_length("text").alias("bytes"))
    return rows.groupBy("family", "agent_file").agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"))


def _family_sql() -> str:
    cases = " ".join(f"WHEN ext IN ({', '.join(quoted(e) for e in names.split())}) THEN {quoted(family)}" for family, names in EXTENSIONS.items())
    names = " ".join(f"WHEN base IN ({', '.join(quoted(n) for n in v.split())}) THEN {quoted(k)}" for k, v in BASENAMES.items())
    agents = ", ".join(quoted(a) for a in AGENT_FILES)
    return f"""WITH seeded AS ({seeded_sql()}),
    named AS (SELECT text, lower(path) AS low, regexp_extract(path, '[^/]*$') AS base, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '.(\\.[^.]*)$', 1)) AS ext FROM seeded),
    kinds AS (SELECT CASE {names} WHEN starts_with(base, 'Dockerfile') THEN 'hash' {cases} ELSE 'document' END AS family,
      (lower(base) IN ({agents}) OR low IN ({agents}) OR regexp_matches(low, {quoted(AGENT_FOLDERS)})) AS agent_file, octet_length(encode(text)) AS bytes FROM named)
    SELECT family, agent_file, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM kinds GROUP BY ALL"""


ORACLE_SQL["language_families"] = _family_sql()


@query
def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page paths under the default excludes and two more globs, as ignore files would decide."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", r"^[^:]*://[^/]*/([^?#]*)", 1).alias("path"))
    globs = GlobSet([*DEFAULT_EXCLUDES, "fr/", "*.html", "!en/*.html"])
    return pages.select("page_id", "path", globs.excluded(F.col("path")).alias("excluded"))


ORACLE_SQL["excluded_paths"] = r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/]*/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, starts_with(path, 'fr/') AND length(path) > 3 OR (ends_with(path, '.html') AND NOT regexp_matches(path, '^en/[^/]*\.html$')) AS excluded FROM p"""


@query
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(seeded(spark, sf_dir), store=False).stats().select("files_scanned", F.col("bytes_scanned").cast("long").alias("bytes_scanned"))


ORACLE_SQL["scan_stats"] = f"SELECT count(*) AS files_scanned, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes_scanned FROM ({seeded_sql()})"


@query
def inline_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with an ignore marker, what they cover, and the rules named."""
    lines = seeded(spark, sf_dir).where(F.col("text").contains("scan-ignore")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).where(F.col("line").contains("scan-ignore"))
    next_line = F.col("line").contains("scan-ignore-next-line")
    rules = F.array_join(F.filter(F.split(F.regexp_extract("line", r"scan-ignore(-next-line)?(?:\s*[: ]\s*([A-Za-z0-9/_,\s-]+))?", 2), r"[,\s]+"), lambda x: x.contains("/")), ",")
    return lines.select("doc_id", (F.col("i") + F.when(next_line, 2).otherwise(1)).cast("long").alias("covers"), rules.alias("rules"))


ORACLE_SQL["inline_ignores"] = f"""WITH seeded AS ({seeded_sql()}), l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM seeded))
SELECT doc_id, i + CASE WHEN contains(line, 'scan-ignore-next-line') THEN 1 ELSE 0 END AS covers,
  coalesce(array_to_string(list_filter(string_split_regex(regexp_extract(line, 'scan-ignore(-next-line)?(?:\\s*[: ]\\s*([A-Za-z0-9/_,\\s-]+))?', 2), '[,\\s]+'), lambda x: contains(x, '/')), ','), '') AS rules
FROM l WHERE contains(line, 'scan-ignore')"""


_CHAT = "SELECT row_number() OVER (ORDER BY conv_id, turn) AS doc_id, 'chat/' || conv_id || '/' || turn || '.txt' AS path, text FROM conversations"
_CHAT_SQL = proof.findings_sql(_CHAT, ("python",), "SELECT t.role, count(*) AS turns, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings FROM conversations t LEFT JOIN (SELECT file, count(*) AS n FROM judged GROUP BY file) ON file = 'chat/' || conv_id || '/' || turn || '.txt' GROUP BY ALL")
_PAGES = "SELECT page_id AS doc_id, 'pages/' || page_id || '.html' AS path, html AS text FROM pages"
_PAGE_SQL = proof.findings_sql(_PAGES, ("markup",), "SELECT regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, count(*) AS pages, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings FROM pages LEFT JOIN (SELECT file, count(*) AS n FROM judged GROUP BY file) ON file = 'pages/' || page_id || '.html' GROUP BY ALL")
FAMILIES = ("python", "c", "hash", "sql")  # those of the seeded paths that have a lexer


def proven(sql: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _proof(then: str | None = None, allow: str | None = None) -> str:
    return proof.findings_sql(seeded_sql(), FAMILIES, *([then] if then else []), allow=allow)


@proven(proof.spans_sql(seeded_sql(), FAMILIES))
def prose_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of language in every file."""
    return prepare(seeded(spark, sf_dir)).select("doc_id", "family", F.explode("spans").alias("s")).select("doc_id", "family", "s.start", "s.end", "s.kind")


@proven(_proof())
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of all rules, in report order."""
    return scan(seeded(spark, sf_dir)).findings.drop("rank", "rule_ord", "match_ord")


@proven(_proof(f"SELECT {proof.COLUMNS} FROM judged WHERE hidden", allow="already reviewed"))
def suppressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inline markers and an allow pattern hide."""
    return scan(seeded(spark, sf_dir), allow=["already reviewed"]).suppressed.drop("rank", "rule_ord", "match_ord")


@proven(_proof(f"SELECT {proof.COLUMNS} FROM judged WHERE NOT hidden AND fingerprint NOT IN (SELECT fingerprint FROM judged WHERE severity = 'critical')"))
def new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a baseline of all critical ones does not hold."""
    files = seeded(spark, sf_dir)
    rows = written(enrich(raw_findings(files)))
    return judge(rows, files, baseline=rows.where("severity = 'critical'").select("fingerprint")).findings.drop("rank", "rule_ord", "match_ord")


@proven(_proof("SELECT rule_id, base_severity, severity, boosted_by, count(*) AS n FROM judged WHERE boosted_by IS NOT NULL GROUP BY ALL"))
def boosted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that correlation or an agent file raised, by rule and reason."""
    return enrich(raw_findings(seeded(spark, sf_dir))).where("boosted_by is not null").groupBy("rule_id", "base_severity", "severity", "boosted_by").agg(F.count("*").alias("n"))


@proven(_proof("SELECT s.severity, count(j.rule_id) AS findings FROM (VALUES ('info'), ('low'), ('medium'), ('high'), ('critical')) s(severity) LEFT JOIN (SELECT * FROM judged WHERE NOT hidden) j USING (severity) GROUP BY ALL"))
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity_counts(scan(seeded(spark, sf_dir)).findings)


@proven(_proof(f"SELECT {proof.COLUMNS} FROM judged WHERE NOT hidden AND rank >= 2 ORDER BY {proof.BEST_FIRST} LIMIT 20"))
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most severe: a report whose feature is its limit."""
    return scan(seeded(spark, sf_dir), min_severity=SEVERITIES[2], max_findings=20).findings.drop("rank", "rule_ord", "match_ord")


@proven(_proof(proof.GITHUB))
def github_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return github_lines(scan(seeded(spark, sf_dir), min_severity="high").findings)


@proven(_proof("SELECT concat_ws('  ', concat_ws(':', file, line, \"column\"), severity, rule_id, message) AS line FROM judged WHERE NOT hidden AND rank >= 3"))
def compact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_lines(scan(seeded(spark, sf_dir), min_severity="high").findings)


@proven(_CHAT_SQL)
def chat_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as text files, findings by role (the tables hold few, so the count of turns comes along)."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("path", F.concat_ws("/", F.lit("chat"), F.col("conv_id").cast("string"), F.concat(F.col("turn").cast("string"), F.lit(".txt"))))
    found = raw_findings(turns.select("path", "text")).select("path", F.size("raw").alias("n"))
    return turns.join(found, "path", "left").groupBy("role").agg(F.count("*").alias("turns"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))


@proven(_PAGE_SQL)
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as markup files, all rules: pages and findings by declared language."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    found = raw_findings(pages).select("path", F.size("raw").alias("n"))
    kinds = pages.select("path", F.regexp_extract("text", r'<html lang="([^"]*)"', 1).alias("lang"))
    return kinds.join(found, "path", "left").groupBy("lang").agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))


@proven(_proof("SELECT path AS file, 'rule ' || rule || ' matched ' || n || ' times; only the first 50 are reported' AS message FROM (SELECT x.path, rule, count(*) AS n FROM numbered x JOIN sweep s USING (doc_id, rule, k) WHERE s.kept GROUP BY ALL) WHERE n > 50"))
def scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that found more in a file than is reported."""
    return scan(seeded(spark, sf_dir)).errors


@proven(_proof("""SELECT a.fingerprint, a.rule_id AS rule, a.file, a.line, left(a.snippet, 200) AS snippet, CASE WHEN a.critical THEN 'reviewed' END AS note, CAST(CASE WHEN a.critical THEN 2 ELSE 1 END AS BIGINT) AS version
  FROM (SELECT *, severity = 'critical' AS critical, row_number() OVER (PARTITION BY fingerprint ORDER BY severity = 'critical' DESC, rank, file DESC, line DESC, "column" DESC, ord DESC, match_ord DESC) AS k FROM judged WHERE NOT hidden) a WHERE k = 1"""))
def merged_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline of all findings, merged with a review of the critical ones: the later entry of a fingerprint counts."""
    found = scan(seeded(spark, sf_dir)).findings
    first = baselines.merged(baselines.current(spark, f"{shared_dir(spark)}/none"), baselines.entries(found), 1)
    return baselines.merged(first, baselines.entries(found.where("severity = 'critical'"), "reviewed"), 2).drop("ordinal")


@proven(_proof("""SELECT doc_id, rule AS rule_id, CAST(n AS INTEGER) AS pattern, CAST(idx AS INTEGER) AS idx, m AS "match", prose, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS INTEGER) AS line,
  CAST(length(regexp_extract(head, '[^\\n]*$')) + len(regexp_extract_all(regexp_extract(head, '[^\\n]*$'), '[\\x{10000}-\\x{10FFFF}]')) + 1 AS INTEGER) AS "column"
  FROM (SELECT *, left(text, idx) AS head FROM placed)"""))
def text_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of all patterns by the table function, in a lateral join of SQL."""
    register(spark)
    return spark.sql("SELECT d.doc_id, m.* FROM {docs} d, LATERAL text_matches(d.path, d.text, CAST(NULL AS STRING), true) m", docs=seeded(spark, sf_dir))


def _shares(doc) -> Column:
    """Divides by zero where a text's length is divisible by 7."""
    return F.when(F.floor(F.lit(100) / (F.length(doc.text) % 7)) >= 50, F.array(raw(F.lit(0), F.left(doc.text, F.lit(5))))).otherwise(F.array().cast(RAWS))


@proven(f"""SELECT path AS file, CASE length(text) % 7 WHEN 0 THEN 'rule own/share failed on this file, which it did not check: its expression raised an error' ELSE 'Own.' END AS message,
  CASE length(text) % 7 WHEN 0 THEN 'error' ELSE 'finding' END AS kind FROM ({seeded_sql()}) WHERE length(text) % 7 <= 2""")
def guarded_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule whose expression raises in some rows, beside all others: its findings and its errors."""
    own = Rule("own/share", "Own", "own", 1, "Own.", scan=_shares)
    result = scan(seeded(spark, sf_dir), rules=[own, *D.RULES], boost=False)
    kinds = lambda df, kind: df.select("file", "message", F.lit(kind).alias("kind"))
    found = judged_of(result, own.id)
    return kinds(found, "finding").unionByName(kinds(result.errors.where(F.col("message").startswith(f"rule {own.id} ")), "error"))


def judged_of(result, rule_id: str) -> DataFrame:
    """A rule's findings, suppressed ones too."""
    return result.findings.unionByName(result.suppressed).where(F.col("rule_id") == rule_id)


#: Globs of ignore files, the column they judge, and the regular expression that they mean (the last: one set of two, the later takes back).
_GLOBS = {
    "one_character": (["en/?5"], "path", "^en/[^/]5(/.*)?$"),
    "any_folders": (["**/en/*5"], "below_host", "^(.*/)?en/[^/]*5(/.*)?$"),
    "classes": (["[ef][!s]/[1-3]*"], "path", "^[ef][^s]/[1-3][^/]*(/.*)?$"),
    "anchored": (["/de"], "path", "^de(/.*)?$"),
    "anywhere": (["4*"], "below_host", "^(.*/)?4[^/]*(/.*)?$"),
    "inner_folders": (["blog.*/**/7??"], "below_host", "^blog\\.[^/]*/(.*/)?7[^/][^/](/.*)?$"),
    "taken_back": (["*.html", "!**/en/*.html"], "below_host", None),
}
_PAGE_PATHS = "SELECT page_id, regexp_extract(url, '^[^:]*://[^/]*/([^?#]*)', 1) AS path, regexp_extract(url, '^[^:]*://([^?#]*)', 1) AS below_host FROM pages"


@proven(f"""SELECT page_id, {', '.join(f"regexp_matches({on}, {quoted(meant)}) AS {name}" for name, (_, on, meant) in _GLOBS.items() if meant)},
  ends_with(below_host, '.html') AND NOT regexp_matches(below_host, '^(.*/)?en/[^/]*\\.html$') AS taken_back FROM ({_PAGE_PATHS})""")
def globbed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of glob matches among the page paths."""
    path = lambda pattern: F.regexp_extract("url", pattern, 1)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", path(r"^[^:]*://[^/]*/([^?#]*)").alias("path"), path(r"^[^:]*://([^?#]*)").alias("below_host"))
    return pages.select("page_id", *[GlobSet(globs).column(F.col(on)).alias(name) for name, (globs, on, _) in _GLOBS.items()])

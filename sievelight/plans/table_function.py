"""``text_matches``: the patterns of the rules as a table function of SQL.

    register(spark)
    spark.sql("SELECT d.id, m.* FROM docs d, LATERAL text_matches(d.path, d.text, 'injection/role-marker', true) m")

One row for each match of each pattern, before confirmation and deduplication, in the text that rules see (comment continuation markers blanked).
``only`` (a constant, or null for all) names rules, separated by commas; ``places`` (a constant) adds ``line`` and ``column``, so the columns follow the
arguments.  A null path or text gives no rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.detectors import RULES, select_rules
from ..operators.matching import Lines, matcher
from ..operators.prose import family_name, lexed

NAME = "text_matches"


def _chosen(only: str | None) -> list[tuple[str, int, tuple]]:
    """``(rule, number, spec)`` of each pattern of the named rules."""
    rules = select_rules([x.strip() for x in only.split(",") if x.strip()]) if only else RULES
    return [(r.id, n, (p.java, p.gate, p.needles, p.foreign, p.first_only, 0)) for r in rules for n, p in enumerate(r.patterns, 1)]


def _constant(argument: AnalyzeArgument, name: str):
    if not argument.isConstantExpression:
        raise ValueError(f"{NAME}: {name} must be a constant")
    return argument.value


@udtf
class TextMatches:
    @staticmethod
    def analyze(path: AnalyzeArgument, text: AnalyzeArgument, only: AnalyzeArgument | None = None, places: AnalyzeArgument | None = None) -> AnalyzeResult:
        if only is not None and (names := _constant(only, "only")):
            _chosen(names)  # unknown rules are an error of the query, not of its tasks
        schema = StructType().add("rule_id", StringType()).add("pattern", IntegerType()).add("idx", IntegerType()).add("match", StringType()).add("prose", BooleanType())
        if places is not None and _constant(places, "places"):
            schema = schema.add("line", IntegerType()).add("column", IntegerType())
        return AnalyzeResult(schema)

    def eval(self, path, text, only=None, places=None):
        if path is None or text is None:
            return
        chosen = _chosen(only)
        family = family_name(path)
        seen, found = lexed(text, family)
        starts, ends = [s for s, _, _ in found], [e for _, e, _ in found]
        hits, failed = matcher(tuple(spec for *_, spec in chosen)).hits(seen, starts, ends, family == "document")
        if failed:
            raise ValueError(f"{NAME}: {chosen[failed[0]['k']][0]}: {failed[0]['why']}")
        lines = Lines(text) if places and hits else None
        for h in hits:
            rule, number, _ = chosen[h["k"]]
            yield (rule, number, h["idx"], h["match"], bool(h["prose"]), *(lines.locate(h["idx"]) if places else ()))


def register(spark: SparkSession) -> None:
    spark.udtf.register(NAME, TextMatches)

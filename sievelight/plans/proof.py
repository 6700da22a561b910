"""Standard SQL that checks the scan: the lexer, all rules and the report columns over any ``files(doc_id, path, text)``.

It is written apart from the plans, from what the rules mean: joins and windows over rows of spans and matches, a recursive sweep,
with RE2 forms of the patterns.  It is made for the supplied tables: white space is ASCII, hidden markup closes with one of a few tags, and long
matches hold no characters beyond 16 bits.
"""

from __future__ import annotations

import re

from ..operators import detectors as D
from ..operators.model import SEVERITIES
from ..operators.patterns import ADDRESSEE, AGENT_NAME, IMPERATIVE, INSTRUCTIONAL, INTEGRATION, PATTERNS
from ..operators.prose import AGENT_FILES, AGENT_FOLDERS, BASENAMES, EXTENSIONS, FAMILIES
from ..sources.tables import quoted

BLANK = r"[ \t\x0b\f\r]"
GAP = rf"^{BLANK}*\n?{BLANK}*(?://|#+|--|;+|%|\*|REM|::)?{BLANK}*$"
CONTINUED = rf"\n{BLANK}*(?://+|#+|--+|;+|\*+|>+|%)"
TAGS_CLOSED = ("div", "p", "span")
INFO, LOW, MEDIUM, HIGH, CRITICAL = range(5)


def kinds_sql(files: str) -> str:
    """``(doc_id, path, text, family, agent)`` of files."""
    cases = " ".join(f"WHEN ext IN ({', '.join(quoted(e) for e in names.split())}) THEN {quoted(family)}" for family, names in EXTENSIONS.items())
    names = " ".join(f"WHEN base IN ({', '.join(quoted(n) for n in v.split())}) THEN {quoted(k)}" for k, v in BASENAMES.items())
    agents = ", ".join(quoted(a) for a in AGENT_FILES)
    return f"""SELECT doc_id, path, text, CASE {names} WHEN starts_with(base, 'Dockerfile') THEN 'hash' {cases} ELSE 'document' END AS family,
      (lower(base) IN ({agents}) OR low IN ({agents}) OR regexp_matches(low, {quoted(AGENT_FOLDERS)})) AS agent
    FROM (SELECT doc_id, path, text, lower(path) AS low, regexp_extract(path, '[^/]*$') AS base, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '.(\\.[^.]*)$', 1)) AS ext FROM ({files}))"""


def _body(closer: str) -> tuple[str, str]:
    """What a block comment holds, and its end, without looking ahead."""
    x = [re.escape(c) for c in closer]
    if closer == "-->":
        return r"(?:[^-]|-[^-]|--+[^->])*", r"(?:--+>|-*)"
    if len(closer) == 2 and closer[0] == closer[1]:
        return rf"(?:[^{x[0]}]|{x[0]}[^{x[0]}])*", rf"(?:{x[0]}{x[0]}|{x[0]}?)"
    return rf"(?:[^{x[0]}]|{x[0]}+[^{x[0]}{x[1]}])*", rf"(?:{x[0]}+{x[1]}|{x[0]}*)"


def _string(q: str) -> tuple[str, str]:
    c = q[0]
    if len(q) == 3:
        return rf"(?:\\[\s\S]?|[^\\{c}]|{c}{{1,2}}(?:[^\\{c}]|\\[\s\S]?))*{c}{{0,2}}", rf"(?:{c}{{3}})?"
    return (rf"(?:\\[\s\S]?|[^\\{c}])*" if q == "`" else rf"(?:\\[\s\S]?|[^\\\n{c}])*"), f"{c}?"


def _tokens(family: str) -> list[tuple[str, str, str, str, str]]:
    """(opener, closer, body, end, kind), longest openers first."""
    lines, blocks, strings = FAMILIES[family]
    out = [(o, c, *_body(c), "comment") for o, c in blocks] + [(o, "", r"[^\n]*", "", "comment") for o in lines]
    out += [(q, q, *_string(q), "string") for q in strings]
    return sorted(out, key=lambda t: -len(t[0]))


def _spans_of(family: str) -> str:
    tokens = _tokens(family)
    every = "|".join(re.escape(o) + body + end for o, _, body, end, _ in tokens)
    kind = "CASE " + " ".join(f"WHEN starts_with(m, {quoted(o)}) THEN {quoted(k)}" for o, *_, k in tokens) + " END"
    skip = "CASE " + " ".join(f"WHEN starts_with(m, {quoted(o)}) THEN {len(o)}" for o, *_ in tokens) + " END"

    def held(o, c, body):
        if c == "":
            return f"length(m) - {len(o)}"
        if c == o:
            return f"length(regexp_extract(m, {quoted('^' + re.escape(o) + '(' + body + ')' + _string(o)[1] + '$')}, 1))"
        return f"CASE WHEN length(m) >= {len(o) + len(c)} AND ends_with(m, {quoted(c)}) THEN length(m) - {len(o) + len(c)} ELSE length(m) - {len(o)} END"

    size = "CASE " + " ".join(f"WHEN starts_with(m, {quoted(o)}) THEN {held(o, c, body)}" for o, c, body, *_ in tokens) + " END"
    at = "CAST(list_sum(list_transform(seg[1:k], lambda s: length(s))) + CASE WHEN k > 1 THEN list_sum(list_transform(ms[1:k - 1], lambda s: length(s))) ELSE 0 END AS BIGINT)"
    return f"""SELECT doc_id, pos + {skip} AS start, pos + {skip} + {size} AS stop, {kind} AS kind FROM (
      SELECT doc_id, {at} AS pos, ms[k] AS m FROM (
        SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (
          SELECT doc_id, string_split_regex(text, {quoted(every)}) AS seg, regexp_extract_all(text, {quoted(every)}) AS ms FROM kinds WHERE family = {quoted(family)}) WHERE len(ms) > 0))"""


def spans_ctes(files: str, families: tuple[str, ...]) -> str:
    """CTEs ``kinds`` and ``spans(doc_id, start, stop, kind)``, merged."""
    each = " UNION ALL ".join(_spans_of(f) for f in families)
    return f"""kinds AS MATERIALIZED ({kinds_sql(files)}),
raw_spans AS (SELECT * FROM ({each}) WHERE stop > start),
stepped AS (SELECT s.*, lag(kind) OVER w AS before, lag(stop) OVER w AS reached, k.text FROM raw_spans s JOIN kinds k USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
joined AS (SELECT *, CASE WHEN before = kind AND (reached = start OR kind = 'comment' AND regexp_matches(substr(text, reached + 1, start - reached), {quoted(GAP)})) THEN 0 ELSE 1 END AS fresh FROM stepped),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS g FROM joined),
spans AS MATERIALIZED (SELECT doc_id, min(start) AS start, max(stop) AS stop, any_value(kind) AS kind FROM grouped GROUP BY doc_id, g
  UNION ALL SELECT doc_id, 0, length(text), 'document' FROM kinds WHERE family = 'document')"""


def spans_sql(files: str, families: tuple[str, ...]) -> str:
    return f"""WITH {spans_ctes(files, families)}
SELECT s.doc_id, k.family, CAST(s.start AS INTEGER) AS start, CAST(s.stop AS INTEGER) AS "end", s.kind FROM spans s JOIN kinds k USING (doc_id)"""


# Matches: one entry a pattern, as (rule, pattern, flags, rank or none, prose only, first only).


def _listed() -> list[tuple]:
    cased = {("injection/role-marker", 1), ("injection/role-marker", 2), ("injection/role-marker", 5), ("injection/exfiltration", 4), ("concealment/markdown-metadata", 2), ("concealment/markdown-metadata", 3)}
    ranks = {
        ("injection/instruction-override", 8): HIGH, ("injection/role-marker", 1): CRITICAL, ("injection/role-marker", 2): CRITICAL, ("injection/role-marker", 3): HIGH, ("injection/role-marker", 4): MEDIUM,
        ("injection/role-marker", 5): CRITICAL, ("injection/trust-assertion", 6): MEDIUM, ("injection/trust-assertion", 7): MEDIUM, ("injection/agent-targeting", 2): CRITICAL, ("injection/agent-targeting", 3): CRITICAL,
        ("injection/agent-targeting", 4): MEDIUM, ("injection/exfiltration", 2): HIGH, ("injection/exfiltration", 3): HIGH, ("injection/exfiltration", 4): HIGH, ("injection/tool-abuse", 2): CRITICAL,
        ("injection/tool-abuse", 3): HIGH, ("injection/tool-abuse", 4): HIGH, ("injection/tool-abuse", 5): CRITICAL, ("concealment/markdown-metadata", 2): MEDIUM, ("concealment/markdown-metadata", 3): MEDIUM,
    }
    anywhere = {("injection/role-marker", 1), ("injection/role-marker", 2), ("injection/role-marker", 5), ("injection/exfiltration", 4), ("injection/tool-abuse", 2), ("injection/tool-abuse", 4), ("injection/tool-abuse", 5)}
    out = []
    for rule, patterns in PATTERNS.items():
        for n, p in enumerate(patterns, 1):
            flags = "" if (rule, n) in cased else "im" if p.startswith("^") else "i"
            out.append((rule, n, p.replace(r"[ \t]*(?=\S)", r"[ \t]*\S"), flags, ranks.get((rule, n)), (rule, n) not in anywhere and not rule.startswith("concealment"), (rule, n) == ("injection/agent-targeting", 4)))
    out += [("unicode/tag-characters", 1, r"[\x{E0000}-\x{E007F}]+", "", None, False, False), ("unicode/variation-selector-payload", 1, r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]{3,}", "", None, False, False)]
    out += [("unicode/invisible-characters", 1, D._class(D.INVISIBLE) + "+", "", None, False, False), ("unicode/bidi-override", 1, D._class(D.BIDI), "", None, False, False)]
    out += [("unicode/homoglyph", 1, r"[\p{L}\p{M}\p{Nd}_]{3,}", "", None, False, False), ("unicode/control-characters", 1, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+", "", None, False, False)]
    out += [("encoding/base64-instruction", 1, D.BASE64, "", None, False, False)]
    out += [("encoding/escaped-text", n, p, "", None, False, False) for n, p in enumerate(D.ESCAPES.values(), 1)]
    out += [("encoding/decode-and-execute", n, p, "i", None, False, False) for n, p in enumerate((D.DECODE_THEN_RUN, D.RUN_THEN_DECODE), 1)]
    for n, p in enumerate(D.HIDING.values(), 1):
        for tag in TAGS_CLOSED:
            out.append(("concealment/hidden-markup", n, p.replace(r"<([a-z][\w-]*)\b", rf"<{tag}\b").replace(r"<\/\1>", f"</{tag}>"), "i", None, False, False))
    out += [("concealment/offscreen-text", 1, D.HORIZONTAL, "m", None, False, False), ("concealment/offscreen-text", 2, D.VERTICAL, "", None, False, False)]
    return out


def _found() -> str:
    """Rows of matches (doc_id, rule, n, j, idx, m, rank, prose_only) over the texts that rules see."""
    each = []
    for rule, n, p, flags, rank, prose, first in _listed():
        options = ", 'i'" if "i" in flags else ""
        p = quoted(("(?m)" if "m" in flags else "") + p)
        each.append(f"""SELECT doc_id, {quoted(rule)} AS rule, {n} AS n, string_split_regex(rt, {p}{options}) AS seg, regexp_extract_all(rt, {p}, 0{options}) AS ms, {'NULL' if rank is None else rank} AS rank, {prose} AS prose_only, {1 if first else 10**6} AS most
          FROM seen WHERE regexp_matches(rt, {p}{options})""")
    at = "CAST(list_sum(list_transform(seg[1:j], lambda s: length(s))) + CASE WHEN j > 1 THEN list_sum(list_transform(ms[1:j - 1], lambda s: length(s))) ELSE 0 END AS BIGINT)"
    label = "rule = 'injection/role-marker' AND n = 4"
    return f"""SELECT doc_id, rule, n, j, idx, CASE WHEN {label} THEN left(m, length(m) - 1) ELSE m END AS m, rank, prose_only FROM (
      SELECT doc_id, rule, n, j, {at} AS idx, ms[j] AS m, rank, prose_only FROM (
        SELECT *, unnest(range(1, 1 + least(most, len(ms)))) AS j FROM ({' UNION ALL '.join(each)})))"""


def _has(text: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({text}, {quoted(pattern)}{', ' + quoted(flags) if flags else ''})"


def _group(pattern: str, text: str, n: int = 1, flags: str = "") -> str:
    return f"regexp_extract({text}, {quoted(pattern)}, {n}{', ' + quoted(flags) if flags else ''})"


def _near(radius: int, at: str = "idx") -> str:
    return f"substr(rt, 1 + CAST(greatest(0, {at} - {radius}) AS BIGINT), CAST({at} + {radius} - greatest(0, {at} - {radius}) AS BIGINT))"


def _flat(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _preview(x: str, limit: int) -> str:
    return f"CASE WHEN length({_flat(x)}) > {limit} THEN left({_flat(x)}, {limit}) || '...' ELSE {_flat(x)} END"


def _points(x: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: 'U+' || lpad(upper(to_hex(unicode(c))), CAST(greatest(4, length(to_hex(unicode(c)))) AS INTEGER), '0')), ' ')"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


_CODES = "regexp_extract_all(m, {p}, 1)"
_PROSE_LIKE = r"(length(regexp_replace({t}, '[^\t\n\r\x20-\x7e]', '', 'g')) >= 0.85 * length({t}) AND len(regexp_extract_all({t}, '\b[a-zA-Z]{{2,}}\b')) >= 4 AND regexp_matches({t}, '\b(?:the|you|and|are|this|that|not|for|with|your|all|any|is|to|do)\b', 'i'))"


def _rated(prose: str) -> str:
    return f"CASE WHEN {_has('dec', D.DECODED_INJECTION)} THEN {CRITICAL} WHEN {_has('dec', D.DECODED_COMMAND)} THEN {HIGH} WHEN {prose} AND {_PROSE_LIKE.format(t='dec')} THEN {MEDIUM} END"


def _decoded() -> str:
    """The text that a match stands for, where its rule decodes."""
    hexes = lambda p: f"array_to_string(list_transform(regexp_extract_all(m, {quoted(p)}, 1), lambda h: chr(CAST('0x' || h AS INTEGER))), '')"
    visible = lambda base: f"array_to_string(list_transform(list_filter(string_split(m, ''), lambda c: c <> '' AND unicode(c) BETWEEN {base + 0x20} AND {base + 0x7E}), lambda c: chr(unicode(c) - {base})), '')"
    digits = "regexp_replace(m, '=+$', '')"
    whole = f"CASE WHEN length({digits}) % 4 = 1 THEN left({digits}, length({digits}) - 1) ELSE {digits} END"
    data = f"from_base64(rpad({whole}, CAST(4 * ceil(length({whole}) / 4.0) AS INTEGER), '='))"
    kinds = list(D.ESCAPES)
    return f"""CASE
      WHEN rule = 'unicode/tag-characters' THEN {visible(0xE0000)}
      WHEN rule = 'unicode/variation-selector-payload' THEN {visible(0xE00F0)}
      WHEN rule = 'unicode/homoglyph' THEN translate(m, '{D.LOOKALIKES}', '{D.LATIN}')
      WHEN rule = 'encoding/base64-instruction' AND length(m) <= 8192 AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') THEN
        CASE WHEN octet_length({data}) >= 8 AND abs(octet_length({data}) - length(m) * 3 / 4.0) <= 3 THEN TRY(decode({data})) END
      WHEN rule = 'encoding/escaped-text' AND length(m) <= 8192 THEN CASE n
        WHEN {1 + kinds.index('unicode escapes')} THEN {hexes(r'\\u\{?([0-9a-fA-F]{2,6})\}?')}
        WHEN {1 + kinds.index('hex escapes')} THEN {hexes(r'\\x([0-9a-fA-F]{2})')}
        WHEN {1 + kinds.index('percent-encoding')} THEN {hexes('%([0-9a-fA-F]{2})')}
        WHEN {1 + kinds.index('a hex byte array')} THEN {hexes('0x([0-9a-fA-F]{2})')}
        ELSE array_to_string(list_transform(regexp_extract_all(m, '(\\d{{1,3}})', 1), lambda d: chr(CAST(d AS INTEGER))), '') END
      WHEN rule = 'concealment/hidden-markup' THEN {_strip("regexp_replace(" + _hidden_inner() + ", '<[^>]*>', ' ', 'g')")}
      WHEN rule = 'concealment/offscreen-text' THEN CASE n WHEN 1 THEN {_group(D.HORIZONTAL, 'm')} ELSE {_group(D.VERTICAL, 'm')} END
    END"""


def _hidden_inner() -> str:
    return "CASE n " + " ".join(f"WHEN {n} THEN coalesce({', '.join('nullif(' + _group(p.replace(r'<([a-z][' + chr(92) + r'w-]*)' + chr(92) + 'b', '^<' + tag + chr(92) + 'b').replace(r'<\/\1>', '</' + tag + '>$'), 'm', 1, 'i') + ', ' + quoted('') + ')' for tag in TAGS_CLOSED)}, '')" for n, p in enumerate(D.HIDING.values(), 1)) + " END"


def _label(names) -> str:
    return "CASE n " + " ".join(f"WHEN {k} THEN {quoted(x)}" for k, x in enumerate(names, 1)) + " END"


def _rank() -> str:
    """A match's rank, or none if its rule does not report it."""
    note = PATTERNS["concealment/markdown-metadata"]
    by = {
        "unicode/tag-characters": str(CRITICAL), "unicode/variation-selector-payload": str(CRITICAL), "unicode/invisible-characters": f"CASE WHEN length(m) >= 8 THEN {CRITICAL} ELSE {HIGH} END",
        "unicode/bidi-override": f"CASE WHEN m IN ({', '.join(quoted(c) for c in D.WEAK_BIDI)}) THEN {MEDIUM} ELSE {CRITICAL} END",
        "unicode/homoglyph": f"CASE WHEN dec <> m AND ascii > 0 AND ascii >= length(m) - alike AND ascii / length(m) >= 0.5 THEN {MEDIUM} END",
        "unicode/control-characters": f"CASE WHEN contains(m, chr(0)) THEN {HIGH} ELSE {MEDIUM} END",
        "encoding/base64-instruction": f"CASE WHEN length(dec) >= 1 THEN {_rated('prose')} END", "encoding/escaped-text": f"CASE WHEN length(dec) >= 8 THEN {_rated('true')} END",
        "encoding/decode-and-execute": str(HIGH), "concealment/hidden-markup": f"CASE WHEN length(dec) >= 12 AND {_has('dec', INSTRUCTIONAL)} THEN CASE WHEN {_has('dec', IMPERATIVE)} THEN {CRITICAL} ELSE {HIGH} END END",
        "concealment/offscreen-text": f"CASE WHEN {_has('dec', INSTRUCTIONAL)} THEN {MEDIUM} END",
        "injection/instruction-override": str(CRITICAL), "injection/role-marker": str(HIGH), "injection/trust-assertion": str(HIGH), "injection/agent-targeting": str(HIGH), "injection/exfiltration": str(CRITICAL), "injection/tool-abuse": str(MEDIUM), "concealment/markdown-metadata": str(HIGH),
    }
    confirm = {
        ("injection/role-marker", 4): f"({_has(_near(200, '(idx + length(m))'), ADDRESSEE)} OR {_has(_near(200, '(idx + length(m))'), AGENT_NAME)})",
        ("injection/agent-targeting", 4): f"({_has(_near(120), IMPERATIVE)} AND NOT {_has(_near(120), INTEGRATION)})",
        ("injection/tool-abuse", 5): f"({_has(_near(300), AGENT_NAME)} OR family = 'document')",
        ("concealment/markdown-metadata", 1): _has(_group(note[0], "m", 1, "i"), INSTRUCTIONAL),
        ("concealment/markdown-metadata", 2): f"({_has(_group(note[1], 'm'), IMPERATIVE)} AND {_has(_near(200), AGENT_NAME)})",
        ("concealment/markdown-metadata", 3): f"({_has(_group(note[2], 'm'), IMPERATIVE)} AND {_has(_group(note[2], 'm'), INSTRUCTIONAL)})",
    }
    sure = "CASE " + " ".join(f"WHEN rule = {quoted(r)} AND n = {n} THEN {c}" for (r, n), c in confirm.items()) + " ELSE true END"
    return f"CASE WHEN (prose OR NOT prose_only) AND {sure} THEN coalesce(rank, CASE rule {' '.join(f'WHEN {quoted(r)} THEN {x}' for r, x in by.items())} END) END"


def _message() -> str:
    fixed = " ".join(f"WHEN {quoted(r.id)} THEN {quoted(r.message)}" for r in D.RULES)
    names = "CASE m " + " ".join(f"WHEN {quoted(chr(c))} THEN {quoted(n)}" for c, n in D.BIDI.items()) + " END"
    run = lambda least, what: f"CASE WHEN length(dec) >= {least} THEN 'Text hidden in {what}: \"' || {_preview('dec', 120)} || '\"' ELSE length(m) || ' {what} in a row' END"
    return f"""CASE rule
      WHEN 'unicode/tag-characters' THEN {run(3, 'invisible tag characters')} WHEN 'unicode/variation-selector-payload' THEN {run(4, 'variation selectors')}
      WHEN 'unicode/invisible-characters' THEN length(m) || ' zero-width character(s): ' || {_points('left(m, 6)')}
      WHEN 'unicode/bidi-override' THEN {names} || ' (' || {_points('m')} || ') changes the order in which this line is shown'
      WHEN 'unicode/homoglyph' THEN '"' || m || '" mixes scripts and reads as "' || dec || '"'
      WHEN 'unicode/control-characters' THEN length(m) || CASE WHEN contains(m, chr(0)) THEN ' control byte(s) with a NUL: ' ELSE ' control character(s): ' END || {_points('left(m, 6)')}
      WHEN 'encoding/base64-instruction' THEN CASE base WHEN {CRITICAL} THEN 'Base64 of instructions to a model: "' WHEN {HIGH} THEN 'Base64 of commands: "' ELSE 'Base64 of readable text: "' END || {_preview('dec', 160)} || '"'
      WHEN 'encoding/escaped-text' THEN 'Text hidden in ' || {_label(D.ESCAPES)} || ': "' || {_preview('dec', 160)} || '"'
      WHEN 'concealment/hidden-markup' THEN 'Instructions hidden with ' || {_label(D.HIDING)}
      WHEN 'concealment/offscreen-text' THEN 'Instructions moved out of view by ' || {_label(['horizontal padding', 'vertical padding'])}
      WHEN 'agent-config/auto-loaded-instructions' THEN 'Agents load ' || path || ' as instructions by themselves'
      ELSE CASE rule {fixed} END END"""


def _detail() -> str:
    names = "CASE m " + " ".join(f"WHEN {quoted(chr(c))} THEN {quoted(n)}" for c, n in D.BIDI.items()) + " END"
    return f"""CAST(CASE rule
      WHEN 'unicode/tag-characters' THEN to_json({{'decoded': {_preview('dec', 400)}, 'count': length(m)}}) WHEN 'unicode/variation-selector-payload' THEN to_json({{'decoded': {_preview('dec', 400)}, 'count': length(m)}})
      WHEN 'unicode/invisible-characters' THEN to_json({{'count': length(m), 'codepoints': {_points('left(m, 20)')}}})
      WHEN 'unicode/bidi-override' THEN to_json({{'control': {names}}}) WHEN 'unicode/homoglyph' THEN to_json({{'normalised': dec, 'lookalikes': regexp_replace(m, '[^{D.LOOKALIKES}]', '', 'g')}})
      WHEN 'unicode/control-characters' THEN to_json({{'count': length(m), 'codepoints': {_points('left(m, 20)')}}})
      WHEN 'encoding/base64-instruction' THEN to_json({{'decoded': {_preview('dec', 500)}}}) WHEN 'encoding/escaped-text' THEN to_json({{'decoded': {_preview('dec', 500)}, 'encoding': {_label(D.ESCAPES)}}})
      WHEN 'concealment/hidden-markup' THEN to_json({{'technique': {_label(D.HIDING)}, 'hiddenText': left(dec, 300)}})
      WHEN 'concealment/offscreen-text' THEN to_json({{'technique': {_label(['horizontal padding', 'vertical padding'])}}})
      WHEN 'agent-config/auto-loaded-instructions' THEN to_json({{'path': path}}) END AS VARCHAR)"""


def _visible(x: str) -> str:
    from ..functions.text import CONTROL_NAMES

    names = " ".join(f"WHEN {c} THEN '<{n}>'" for c, n in CONTROL_NAMES.items())
    tag = "CASE WHEN unicode(c) BETWEEN 917536 AND 917630 THEN chr(unicode(c) - 917504) ELSE lower(to_hex(unicode(c))) END"
    form = f"""CASE unicode(c) WHEN 9 THEN '\\t' WHEN 10 THEN '\\n' WHEN 13 THEN '\\r' {names} ELSE
      CASE WHEN unicode(c) < 32 OR unicode(c) = 127 THEN '<U+' || lpad(upper(to_hex(unicode(c))), 4, '0') || '>' WHEN unicode(c) BETWEEN 917504 AND 917631 THEN '<TAG:' || {tag} || '>'
        WHEN unicode(c) BETWEEN 65024 AND 65039 THEN '<VS' || (unicode(c) - 65023) || '>' WHEN unicode(c) BETWEEN 917760 AND 917999 THEN '<VS' || (unicode(c) - 917743) || '>' ELSE c END END"""
    return f"array_to_string(list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: {form}), '')"


def _cut(x: str, limit: int) -> str:
    return f"CASE WHEN length({x}) > {limit} THEN left({x}, {limit - 1}) || '…' ELSE {x} END"


def findings_ctes(files: str, families: tuple[str, ...], allow: str | None = None) -> str:
    """CTEs up to ``judged``: every finding with its report columns, ``rank``, ``ord``, ``hidden``."""
    order = {r.id: i for i, r in enumerate(D.RULES)}
    dedupe = ", ".join(quoted(r.id) for r in D.RULES if r.dedupe)
    of = lambda attribute: "CASE rule " + " ".join(f"WHEN {quoted(r.id)} THEN {quoted(getattr(r, attribute))}" for r in D.RULES) + " END"
    names = "CASE {} " + " ".join(f"WHEN {i} THEN {quoted(s)}" for i, s in enumerate(SEVERITIES)) + " END"
    marker = r"scan-ignore(-next-line)?(?:\s*[: ]\s*([A-Za-z0-9/_,\s-]+))?"
    mark = lambda x, n: _group(marker, x, n)
    listed = lambda x: f"list_filter(string_split_regex({mark(x, 2)}, '[,\\s]+'), lambda i: contains(i, '/'))"
    here, above = f"(contains(own, 'scan-ignore') AND {mark('own', 1)} = '')", f"(contains(over, 'scan-ignore') AND {mark('over', 1)} <> '')"
    wide = lambda x: f"(length({x}) + len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"
    permitted = f"regexp_matches(snippet, {quoted(allow)}, 'i') OR regexp_matches(context, {quoted(allow)}, 'i')" if allow else "false"
    blanked = f"""array_to_string(list_transform(range(1, len(string_split_regex(x, {quoted(CONTINUED)})) + 1), lambda i: string_split_regex(x, {quoted(CONTINUED)})[i] ||
      coalesce(regexp_extract(regexp_extract_all(x, {quoted(CONTINUED)})[i], '^\\n{BLANK}*') || repeat(' ', length(regexp_extract_all(x, {quoted(CONTINUED)})[i]) - length(regexp_extract(regexp_extract_all(x, {quoted(CONTINUED)})[i], '^\\n{BLANK}*'))), '')), '')"""
    return f"""{spans_ctes(files, families)},
parts AS (
  SELECT s.doc_id, s.start, s.stop, substr(k.text, s.start + 1, s.stop - s.start) AS x, k.text, coalesce(lag(s.stop) OVER (PARTITION BY s.doc_id ORDER BY s.start), 0) AS reached
  FROM spans s JOIN kinds k USING (doc_id) WHERE s.kind = 'comment' AND contains(substr(k.text, s.start + 1, s.stop - s.start), chr(10))),
rebuilt AS (SELECT doc_id, string_agg(substr(text, reached + 1, start - reached) || {blanked}, '' ORDER BY start) || substr(any_value(text), max(stop) + 1) AS rt FROM parts GROUP BY doc_id),
seen AS MATERIALIZED (SELECT k.*, coalesce(r.rt, k.text) AS rt FROM kinds k LEFT JOIN rebuilt r USING (doc_id)),
found AS MATERIALIZED ({_found()}),
placed AS (
  SELECT f.*, s.path, s.text, s.rt, s.family, EXISTS (SELECT 1 FROM spans p WHERE p.doc_id = f.doc_id AND p.start <= f.idx AND f.idx < p.stop) AS prose
  FROM found f JOIN seen s USING (doc_id)
  WHERE NOT (f.rule = 'unicode/homoglyph' AND NOT regexp_matches(f.m, '[{D.LOOKALIKES}]'))),
read AS (SELECT *, {_decoded()} AS dec, length(regexp_replace(m, '[^\\x00-\\x7f]', '', 'g')) AS ascii, length(regexp_replace(m, '[^{D.LOOKALIKES}]', '', 'g')) AS alike FROM placed),
ranked AS (SELECT * FROM (SELECT *, {_rank()} AS base FROM read) WHERE base IS NOT NULL),
reported AS (
  SELECT doc_id, rule, n, j, base, dec, path, text,
    CASE WHEN rule = 'concealment/offscreen-text' THEN idx + length(m) - length(dec) ELSE idx END AS idx,
    m, CASE rule WHEN 'concealment/offscreen-text' THEN left(dec, 200) WHEN 'concealment/hidden-markup' THEN left(m, 200) WHEN 'encoding/escaped-text' THEN left(m, 120) ELSE m END AS match
  FROM ranked
  UNION ALL SELECT doc_id, 'agent-config/auto-loaded-instructions', 1, 1, {INFO}, NULL, path, text, 0, path, path FROM kinds WHERE agent),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, rule ORDER BY CASE WHEN rule IN ({dedupe}) THEN idx ELSE 0 END, CASE WHEN rule IN ({dedupe}) THEN -length(match) ELSE 0 END, n, j) AS k FROM reported),
sweep(doc_id, rule, k, kept, reach) AS (
  SELECT doc_id, rule, k, true, idx + length(match) FROM numbered WHERE k = 1
  UNION ALL SELECT x.doc_id, x.rule, x.k, x.rule NOT IN ({dedupe}) OR x.idx >= s.reach, CASE WHEN x.idx >= s.reach THEN x.idx + length(x.match) ELSE s.reach END
  FROM sweep s JOIN numbered x ON x.doc_id = s.doc_id AND x.rule = s.rule AND x.k = s.k + 1),
kept AS (
  SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY doc_id, rule ORDER BY x.k) - 1 AS match_ord FROM numbered x JOIN sweep s USING (doc_id, rule, k) WHERE s.kept) WHERE match_ord < 50),
raised AS (
  SELECT *, {of('family')} AS family, count(DISTINCT {of('family')}) OVER (PARTITION BY doc_id) AS families, left(text, CAST(idx AS BIGINT)) AS head, substr(text, CAST(idx + 1 AS BIGINT)) AS tail FROM kept),
boosted AS (
  SELECT r.*, k.agent AND r.family <> 'agent-config' AS auto, families >= 3 AND r.family <> 'agent-config' AS many, regexp_extract(head, '[^\\n]*$') AS before, regexp_extract(tail, '^[^\\n]*') AS behind,
    length(head) - length(replace(head, chr(10), '')) + 1 AS line, string_split(r.text, chr(10)) AS lines
  FROM raised r JOIN kinds k USING (doc_id)),
shown AS (
  SELECT *, least(4, base + CAST(many AS INTEGER) + CAST(auto AS INTEGER)) AS rank, {wide('before')} + 1 AS "column", lines[line] AS own, coalesce(lines[line - 1], '') AS over,
    {_visible('left(match, 160)')} AS s1, {_visible(_strip("CASE WHEN length(before) > 200 THEN '…' ELSE '' END || regexp_replace(right(before, 200) || left(behind, 200), chr(13) || '$', '') || CASE WHEN length(behind) > 200 THEN '…' ELSE '' END"))} AS c1
  FROM boosted),
reports AS (
  SELECT rule AS rule_id, {of('title')} AS rule_title, family, {names.format('rank')} AS severity, {names.format('base')} AS base_severity, path AS file, CAST(line AS INTEGER) AS line, CAST("column" AS INTEGER) AS "column",
    {_cut('s1', 160)} AS snippet, {_cut('c1', 200)} AS context, {_message()} AS message,
    substr(sha256(rule || chr(0) || path || chr(0) || lower({_flat('match')})), 1, 16) AS fingerprint,
    nullif(concat_ws('; ', CASE WHEN many THEN families || ' distinct techniques in this file' END, CASE WHEN auto THEN 'agents load this file by themselves' END), '') AS boosted_by, {_detail()} AS detail,
    rank, CASE rule {' '.join(f'WHEN {quoted(r)} THEN {i}' for r, i in order.items())} END AS ord, match_ord,
    CASE WHEN {here} AND len({listed('own')}) = 0 THEN true WHEN {here} THEN list_contains({listed('own')}, rule) OR ({above} AND list_contains({listed('over')}, rule)) WHEN {above} THEN len({listed('over')}) = 0 OR list_contains({listed('over')}, rule) ELSE false END AS ignored
  FROM shown),
judged AS MATERIALIZED (SELECT *, ignored OR {permitted} AS hidden FROM reports)"""


COLUMNS = 'rule_id, rule_title, family, severity, base_severity, file, line, "column", snippet, context, message, fingerprint, boosted_by, detail'
BEST_FIRST = 'rank DESC, file, line, "column", ord, match_ord'

_ESCAPED = "replace(replace(replace({x}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')"
_PROPERTY = "replace(replace(" + _ESCAPED + ", ':', '%3A'), ',', '%2C')"
GITHUB = f"""SELECT '::' || CASE WHEN rank >= 3 THEN 'error' WHEN rank = 2 THEN 'warning' ELSE 'notice' END || ' file=' || {_PROPERTY.format(x='file')} || ',line=' || line || ',col=' || "column" ||
  ',title=' || {_PROPERTY.format(x="('sievelight: ' || rule_title)")} || '::' || {_ESCAPED.format(x="(message || ' (' || rule_id || ')')")} AS line FROM judged WHERE NOT hidden AND rank >= 3"""


def findings_sql(files: str, families: tuple[str, ...], then: str = f"SELECT {COLUMNS} FROM judged WHERE NOT hidden", allow: str | None = None) -> str:
    return f"WITH RECURSIVE {findings_ctes(files, families, allow)}\n{then}"

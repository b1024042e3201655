"""The library's functions for ``spark.sql``: temporary SQL functions, which Catalyst inlines into a query.

``register(spark)`` defines them; nothing runs in Python.

* ``mask_keep(text, prefix, suffix)``, ``generalize_zh(text, type)``, ``generalize_en(text, type)``
* ``normalize_width(text)``, ``is_luhn(text)``, ``is_ipv4(text)``
* ``find_matches(text, pattern)``: all matches with their places
* ``detect_zh(text)``, ``detect_en(text)``: the spans of all rules in priority order, without overlaps
* ``items_zh(text)``, ``items_en(text)``: the same as a table, for ``LATERAL``

Defined results: those of the Column functions; a null text gives null, or no spans and no rows.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import SparkSession

from cloakframe.functions import rewrite
from cloakframe.operators.rules import Rule, rules_for

SPAN = "struct<start:int,end:int,text:string>"
TYPED = "struct<start:int,end:int,text:string,type:string,rule:int>"
PLACED = f"struct<start:int,i:int,x:{TYPED}>"
#: Plain tests that a text must pass before any pattern with that guard is tried, as in ``spans.GUARDS``.
GUARDS = {"": r"t RLIKE r'\p{Nd}'", "zh": "t RLIKE '[一-鿿]'", "@": "contains(t, '@')", ":": "contains(t, ':')"}


# written out where a lambda's variable is tested: a SQL function cannot take one
LUHN = "char_length(regexp_replace({0}, '[^0-9]', '')) >= 13 AND luhn_check(regexp_replace({0}, '[^0-9]', ''))"
IPV4 = "forall(split({0}, '[.]'), p -> coalesce(try_cast(p AS INT) <= 255, false) AND p RLIKE '^[0-9]+$')"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _raw(pattern: str) -> str:
    """A pattern as a literal without escapes."""
    assert "'" not in pattern
    return f"r'{pattern}'"


def _chain(cases: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END"


def _zh() -> str:
    cuts = [(f"instr(t, '{w}') > 0 AND instr(t, '{w}') + {len(w) - 1} < char_length(t)", f"left(t, instr(t, '{w}') + {len(w) - 1})") for w in rewrite.ZH_CUT]
    address = _chain(cuts + [(f"endswith(t, '{x}')", f"'某{x}'") for x in rewrite.ZH_SUFFIX], "'某地'")
    title = _chain([(f"t RLIKE '{'|'.join(words)}'", f"'{level}'") for level, words in rewrite.ZH_TITLES], "'职员'")
    id_card = "CASE WHEN char_length(t) >= 10 THEN concat(substr(t, 7, 4), '年出生') ELSE '****' END"
    phone = "CASE WHEN char_length(t) >= 3 THEN concat(left(t, 3), '********') ELSE '***' END"
    return _chain([("type = 'Address'", address), ("type = 'Title'", title), ("type = 'IdCard'", id_card), ("type = 'Phone'", phone)], _FIRST)


_FIRST = "CASE WHEN char_length(t) > 1 THEN concat(left(t, 1), '**') ELSE '**' END"


def _en() -> str:
    parts = "transform(split(t, ','), x -> trim(x))"
    address = f"CASE WHEN size({parts}) >= 2 THEN array_join(slice({parts}, -2, 2), ', ') ELSE t END"
    phrases = [(f"lower(t) RLIKE '{'|'.join(words)}'", f"'{level}'") for level, words in rewrite.EN_PHRASES]
    words = [(f"arrays_overlap(split(lower(t), '[^a-z0-9]+'), array({', '.join(_quoted(w) for w in words)}))", f"'{level}'") for level, words in rewrite.EN_TITLES]
    title = _chain(phrases + words, "'Employee'")
    ssn = "CASE WHEN octet_length(t) >= 11 THEN concat('***-**-', substr(t, 8)) ELSE '***-**-****' END"
    digits = "regexp_replace(t, '[^0-9]', '')"
    zip_code = f"CASE WHEN char_length({digits}) >= 3 THEN concat(left({digits}, 3), '**') ELSE '***' END"
    blanks = r"split(trim(t), r'\s+')"
    postcode = f"CASE WHEN size({blanks}) >= 2 THEN concat({blanks}[0], ' ***') WHEN char_length(t) > 3 THEN concat(left(t, char_length(t) - 3), ' ***') ELSE '*** ***' END"
    half = "cast(floor(char_length(t) / 2) AS int)"
    phone = f"CASE WHEN char_length(t) > 6 THEN concat(left(t, {half}), repeat('*', char_length(t) - {half})) ELSE '***' END"
    return _chain([("type = 'Address'", address), ("type = 'Title'", title), ("type = 'Ssn'", ssn), ("type = 'ZipCode'", zip_code), ("type = 'UkPostcode'", postcode), ("type IN ('UsPhone', 'UkPhone')", phone)], _FIRST)


def _rule(rule: Rule, k: int) -> str:
    """The spans of one rule that pass its boundary and check."""
    tests = []
    if rule.boundary is not None:
        blocked = _raw(rule.boundary)
        tests.append(f"NOT (CASE WHEN x.start > 0 THEN substr(t, x.start, 1) ELSE '' END RLIKE {blocked}) AND NOT (substr(t, x.end + 1, 1) RLIKE {blocked})")
    if rule.check:
        tests.append({"luhn": LUHN, "ipv4": IPV4}[rule.check].format("x.text"))
    found = f"find_matches(t, {_raw(rule.pattern)})"
    kept = f"filter({found}, x -> {' AND '.join(tests)})" if tests else found
    typed = f"transform({kept}, x -> named_struct('start', x.start, 'end', x.end, 'text', x.text, 'type', '{rule.type}', 'rule', {k}))"
    # most guarded texts still have no match: one search decides before the fold runs
    return f"CASE WHEN t RLIKE {_raw(rule.pattern)} THEN {typed} ELSE {_none(TYPED)} END"


def _none(kind: str) -> str:
    return f"cast(array() AS array<{kind}>)"


def _guarded(rules: list[tuple[int, Rule]], guard: str) -> str:
    """The spans of neighbouring rules with one guard, which is tested once."""
    return f"CASE WHEN {GUARDS[guard]} THEN concat({', '.join(_rule(r, k) for k, r in rules)}) ELSE {_none(TYPED)} END"


def _no_overlap(spans: str) -> str:
    """``spans.no_overlap``: swept by their starts, only spans that reach into one another are compared.

    Each part is written once, in the place of its use, so it is worked out once.
    """
    run = f"array<{PLACED}>"
    apart = "x.start >= a.reach"
    placed = f"array_sort(transform({spans}, (x, i) -> named_struct('start', x.start, 'i', i, 'x', x)))"
    sweep = f"""named_struct('reach', greatest(a.reach, x.x.end),
  'run', CASE WHEN {apart} THEN array(x) ELSE concat(a.run, array(x)) END,
  'done', CASE WHEN {apart} THEN concat(a.done, array(a.run)) ELSE a.done END)"""
    runs = f"aggregate({placed}, named_struct('reach', 0, 'run', {_none(PLACED)}, 'done', {_none(run)}), (a, x) -> {sweep}, a -> concat(a.done, array(a.run)))"
    in_order = "array_sort({0}, (p, q) -> p.i - q.i)"
    admit = "CASE WHEN exists(kept, y -> x.x.start < y.x.end AND y.x.start < x.x.end) THEN kept ELSE concat(kept, array(x)) END"
    kept = f"flatten(transform({runs}, r -> CASE WHEN size(r) > 1 THEN aggregate({in_order.format('r')}, {_none(PLACED)}, (kept, x) -> {admit}) ELSE r END))"
    return f"transform({in_order.format(kept)}, x -> x.x)"


def _detect(language: str) -> str:
    groups = [_guarded(list(g), guard) for guard, g in groupby(enumerate(rules_for(language)), lambda x: x[1].guard)]
    return _no_overlap(f"concat({', '.join(groups)})")


def definitions() -> list[str]:
    """The statements, in the order of their use."""
    whole = "translate(coalesce(t, ''), '\\u0001', '\\uFFFD')"
    fold = f"""aggregate(split(regexp_replace({whole}, concat('(', pattern, ')'), '\\u0001$1\\u0001'), '\\u0001'),
  named_struct('i', 0, 'at', 0, 'out', cast(array() AS array<{SPAN}>)),
  (a, x) -> named_struct('i', a.i + 1, 'at', a.at + char_length(x), 'out', CASE WHEN a.i % 2 = 1 THEN concat(a.out, array(named_struct('start', a.at, 'end', a.at + char_length(x), 'text', x))) ELSE a.out END),
  a -> a.out)"""
    head = "CREATE OR REPLACE TEMPORARY FUNCTION"
    out = [
        f"{head} mask_keep(t STRING, prefix INT, suffix INT) RETURNS STRING RETURN CASE WHEN char_length(t) = 0 THEN '' WHEN prefix + suffix >= char_length(t) THEN repeat('*', char_length(t)) ELSE concat(left(t, prefix), repeat('*', char_length(t) - prefix - suffix), CASE WHEN suffix > 0 THEN right(t, suffix) ELSE '' END) END",
        f"{head} normalize_width(t STRING) RETURNS STRING RETURN translate(t, '{rewrite.WIDE}', '{rewrite.NARROW}')",
        f"{head} is_luhn(t STRING) RETURNS BOOLEAN RETURN {LUHN.format('t')}",
        f"{head} is_ipv4(t STRING) RETURNS BOOLEAN RETURN {IPV4.format('t')}",
        f"{head} generalize_zh(t STRING, type STRING) RETURNS STRING RETURN {_zh()}",
        f"{head} generalize_en(t STRING, type STRING) RETURNS STRING RETURN {_en()}",
        f"{head} find_matches(t STRING, pattern STRING) RETURNS ARRAY<{SPAN}> RETURN {fold}",
    ]
    for lang in ("zh", "en"):
        out.append(f"{head} detect_{lang}(t STRING) RETURNS ARRAY<{TYPED}> RETURN {_detect(lang)}")
        out.append(f"{head} items_{lang}(t STRING) RETURNS TABLE(start_pos INT, end_pos INT, match STRING, type STRING) RETURN SELECT x.start, x.end, x.text, x.type FROM (SELECT detect_{lang}(t) AS spans) s LATERAL VIEW explode_outer(s.spans) e AS x WHERE x IS NOT NULL")
    return out


def register(spark: SparkSession) -> None:
    """Defines the functions in a session."""
    for statement in definitions():
        spark.sql(statement)

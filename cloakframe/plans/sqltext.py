"""Building blocks of the DuckDB SQL that checks the queries."""

from __future__ import annotations

from cloakframe.operators.rules import Rule


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """A table of literals."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else quoted(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({columns})"


def spans(source: str, pattern: str) -> str:
    """id, s, e, m of all matches of a pattern in a source (id, text)."""
    return f"""SELECT id, s, s + length(m) AS e, m FROM (
  SELECT id, i, m, coalesce(sum(length(m)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS s FROM (
    SELECT id, unnest(parts) AS m, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT id, string_split(regexp_replace(text, {quoted(f"({pattern})")}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM {source} WHERE regexp_matches(text, {quoted(pattern)})))) WHERE i % 2 = 0"""


def literal_spans(source: str, literal: str, fuzzy: bool = False) -> str:
    """id, s, e of all matches of a literal in a source (id, text)."""
    text, lit = ("lower(text)", quoted(literal.lower())) if fuzzy else ("text", quoted(literal))
    return f"""SELECT id, s, s + {len(literal)} AS e FROM (
  SELECT id, i, n, coalesce(sum(length(part) + {len(literal)}) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::INT - {len(literal)} AS s FROM (
    SELECT id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i, len(parts) AS n FROM (SELECT id, string_split({text}, {lit}) AS parts FROM {source} WHERE contains({text}, {lit})))) WHERE i < n"""


LUHN = "(list_sum(list_transform(range(0, len(d)), lambda i: CASE WHEN i % 2 = 0 THEN d[len(d) - i] ELSE CASE WHEN 2 * d[len(d) - i] > 9 THEN 2 * d[len(d) - i] - 9 ELSE 2 * d[len(d) - i] END END)) % 10 = 0)"
LUHN_OK = "(SELECT len(d) >= 13 AND " + LUHN + " FROM (SELECT list_transform(regexp_extract_all(m, '[0-9]'), lambda c: c::INT) AS d))"
IPV4_OK = "list_bool_and(list_transform(string_split(m, '.'), lambda p: regexp_matches(p, '^[0-9]+$') AND try_cast(p AS INT) <= 255))"


def rule_spans(source: str, rule: Rule) -> str:
    """Spans of a rule that pass its boundary and check."""
    cond = "true"
    if rule.boundary:
        cond = f"NOT regexp_matches(CASE WHEN s > 0 THEN substr(text, s, 1) ELSE '' END, '{rule.boundary}') AND NOT regexp_matches(substr(text, e + 1, 1), '{rule.boundary}')"
    check = {"luhn": LUHN_OK, "ipv4": IPV4_OK}.get(rule.check or "", "true")
    return f"SELECT id, s, e, m FROM ({spans(source, rule.pattern)}) JOIN {source} USING (id) WHERE {cond} AND {check}"


def detect(source: str, rules: list[Rule], prefix: str = "r") -> tuple[str, str]:
    """CTEs of the rules in priority order, and the name of the last: id, s, e, m, type, rule.

    Spans of one rule never overlap, so dropping those that overlap earlier rules' is the fold.
    """
    ctes, last = [], None
    for k, rule in enumerate(rules):
        own = f"SELECT id, s, e, m, {quoted(rule.type)} AS type, {k} AS rule FROM ({rule_spans(source, rule)}) x"
        if last:
            own = f"SELECT * FROM {last} UNION ALL {own} WHERE NOT EXISTS (SELECT 1 FROM {last} y WHERE y.id = x.id AND x.s < y.e AND y.s < x.e)"
        ctes.append(f"{prefix}{k} AS MATERIALIZED ({own})")
        last = f"{prefix}{k}"
    return ",\n".join(ctes), last


def mask(text: str, prefix: str, suffix: str) -> str:
    return f"CASE WHEN length({text}) = 0 THEN '' WHEN {prefix} + {suffix} >= length({text}) THEN repeat('*', length({text})) ELSE substr({text}, 1, {prefix}) || repeat('*', length({text}) - {prefix} - {suffix}) || CASE WHEN {suffix} > 0 THEN right({text}, {suffix}) ELSE '' END END"


def splice(items: str, source: str) -> str:
    """id, text with non-overlapping items (id, s, e, replaced) written."""
    return f"""SELECT d.id, CASE WHEN p.id IS NULL THEN d.text ELSE p.body || substr(d.text, p.last + 1) END AS text FROM {source} d LEFT JOIN (
  SELECT id, string_agg(gap || replaced, '' ORDER BY s) AS body, max(e) AS last FROM (
    SELECT i.id, i.s, i.e, i.replaced, substr(d.text, coalesce(lag(i.e) OVER (PARTITION BY i.id ORDER BY i.s), 0) + 1, i.s - coalesce(lag(i.e) OVER (PARTITION BY i.id ORDER BY i.s), 0)) AS gap
    FROM {items} i JOIN {source} d USING (id)) GROUP BY id) p USING (id)"""

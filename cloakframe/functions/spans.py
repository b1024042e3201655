"""Spans of patterns and literals inside a text, as native expressions.

Spark has no "find all with positions".  Matches are fenced with a sentinel, the text is split at
it, and a fold over the pieces adds up their lengths: every second piece is a match.  Offsets are
code points.  The sentinel U+0001 is replaced in texts that hold it, one for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.rules import Rule

MARK = "\u0001"
EMPTY = "cast(array() as array<struct<start:int,end:int,text:string>>)"


def _fold(pieces: Column) -> Column:
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.expr(EMPTY).alias("out"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.char_length(x)
        span = F.array(F.struct(a["at"].alias("start"), end.alias("end"), x.alias("text")))
        return F.struct((a["i"] + 1).alias("i"), end.alias("at"), F.when(a["i"] % 2 == 1, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def clean(text: Column) -> Column:
    """The text without the sentinel, offsets unchanged."""
    return F.translate(F.coalesce(text, F.lit("")), MARK, "�")


def find_spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, text)."""
    fenced = F.regexp_replace(clean(text), f"({pattern})", f"{MARK}$1{MARK}")
    return _fold(F.split(fenced, MARK))


def find_literal(text: Column, literal: Column) -> Column:
    """All leftmost non-overlapping places of a literal; an empty one has none."""
    whole = clean(text)
    fenced = F.replace(whole, literal, F.concat(F.lit(MARK), literal, F.lit(MARK)))
    return F.when((F.char_length(literal) > 0) & F.contains(whole, literal), _fold(F.split(fenced, MARK))).otherwise(F.expr(EMPTY))


def neighbours_free(text: Column, span: Column, blocked: str | None) -> Column:
    """Whether the characters beside a span are outside the class ``blocked``."""
    if blocked is None:
        return F.lit(True)
    before = F.when(span["start"] > 0, F.substring(text, span["start"], F.lit(1))).otherwise("")
    after = F.substring(text, span["end"] + 1, F.lit(1))
    return ~before.rlike(blocked) & ~after.rlike(blocked)


def is_ipv4(text: Column) -> Column:
    """Four numbers of at most 255; digits of other scripts are no numbers here."""
    return F.forall(F.split(text, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)) & p.rlike("^[0-9]+$"))


def luhn(text: Column) -> Column:
    """The Luhn check over the ASCII digits, of which there must be 13 or more."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return (F.char_length(digits) >= 13) & F.call_function("luhn_check", digits)


NO_SPANS = "cast(array() as array<struct<start:int,end:int,text:string,type:string,rule:int>>)"
#: Plain tests that a text must pass before any pattern with that guard is tried.
GUARDS = {"": lambda t: t.rlike(r"\p{Nd}"), "zh": lambda t: t.rlike("[一-鿿]"), "@": lambda t: F.contains(t, F.lit("@")), ":": lambda t: F.contains(t, F.lit(":"))}


def candidates(text: Column, rule: Rule, k: int, guard: Column | None = None) -> Column:
    """The spans of one rule that pass its boundary and its check."""
    whole = clean(text) if guard is None else text
    ok = {"ipv4": is_ipv4, "luhn": luhn}.get(rule.check or "", lambda t: F.lit(True))
    found = F.filter(find_spans(whole, rule.pattern), lambda x: neighbours_free(whole, x, rule.boundary) & ok(x["text"]))
    typed = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(rule.type).alias("type"), F.lit(k).alias("rule")))
    # most guarded texts still have no match: one cheap search decides before the fold runs
    return F.when((GUARDS[rule.guard](whole) if guard is None else guard) & whole.rlike(rule.pattern), typed).otherwise(F.expr(NO_SPANS))


def no_overlap(spans: Column) -> Column:
    """Greedy: a span stays unless it overlaps one that stayed before it.

    Spans are swept by their starts, and only those that reach into one another are compared.
    """
    placed = F.array_sort(F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x.alias("x"))))
    none = F.filter(placed, lambda x: F.lit(False))

    def sweep(a: Column, x: Column) -> Column:
        apart = x["start"] >= a["reach"]
        done = F.when(apart, F.concat(a["done"], F.array(a["run"]))).otherwise(a["done"])
        run = F.when(apart, F.array(x)).otherwise(F.concat(a["run"], F.array(x)))
        return F.struct(F.greatest(a["reach"], x["x"]["end"]).alias("reach"), run.alias("run"), done.alias("done"))

    runs = F.aggregate(placed, F.struct(F.lit(0).alias("reach"), none.alias("run"), F.filter(F.array(none), lambda x: F.lit(False)).alias("done")), sweep, lambda a: F.concat(a["done"], F.array(a["run"])))

    def admit(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda y: (x["x"]["start"] < y["x"]["end"]) & (y["x"]["start"] < x["x"]["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    in_order = lambda r: F.array_sort(r, lambda p, q: p["i"] - q["i"])
    kept = F.flatten(F.transform(runs, lambda r: F.when(F.size(r) > 1, F.aggregate(in_order(r), F.filter(r, lambda x: F.lit(False)), admit)).otherwise(r)))
    return F.transform(in_order(kept), lambda x: x["x"])


def detect_spans(df: DataFrame, text: str, rules: list[Rule], out: str = "spans") -> DataFrame:
    """Adds the spans of all rules in rule order, without overlaps: (start, end, text, type, rule).

    The cleaned text and the guards are columns of their own, so they are worked out once.
    """
    guards = sorted({r.guard for r in rules})
    names = {g: f"__guard_{k}" for k, g in enumerate(guards)}
    staged = df.withColumn("__whole", clean(F.col(text)))
    staged = staged.withColumns({names[g]: GUARDS[g](F.col("__whole")) for g in guards})
    staged = staged.withColumns({f"__rule_{k}": candidates(F.col("__whole"), r, k, F.col(names[r.guard])) for k, r in enumerate(rules)})
    every = F.concat(*[F.col(f"__rule_{k}") for k in range(len(rules))])
    return staged.withColumn("__all", every).withColumn(out, F.when(F.size("__all") > 1, no_overlap(F.col("__all"))).otherwise(F.col("__all"))).select(*df.columns, out)

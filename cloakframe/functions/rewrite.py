"""Mask, generalize and splice, as native expressions over code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_keep(text: Column, prefix: Column | int, suffix: Column | int) -> Column:
    """Stars for all but the ends; all stars if the ends would cover the text."""
    p = F.lit(prefix) if isinstance(prefix, int) else prefix
    s = F.lit(suffix) if isinstance(suffix, int) else suffix
    n = F.char_length(text)
    tail = F.when(s > 0, F.right(text, s)).otherwise("")
    return F.when(n == 0, "").when(p + s >= n, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(text, p), F.repeat(F.lit("*"), n - p - s), tail))


def _chain(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda acc, c: F.when(c[0], c[1]).otherwise(acc), reversed(cases), otherwise)


# Administrative suffixes and title keywords, in the order they are tried.
ZH_CUT = ["特别行政区", "自治区", "省", "市"]
ZH_SUFFIX = ["特别行政区", "自治区", "省", "市", "区", "县", "镇", "村", "街道"]
ZH_TITLES = [
    ("高级管理人员", ["总裁", "总经理", "副总", "董事", "CEO", "CFO", "CTO", "COO"]),
    ("中级管理人员", ["总监", "主任", "部长", "处长", "科长", "局长"]),
    ("基层管理人员", ["经理", "主管", "组长", "队长"]),
    ("技术人员", ["工程师", "架构师", "程序员", "开发", "技术"]),
    ("一般职员", ["专员", "助理", "文员", "秘书"]),
]
EN_PHRASES = [("Director-Level", ["vice president", "head of"]), ("Management", ["team lead"])]
EN_TITLES = [
    ("Senior Executive", ["chief", "ceo", "cfo", "cto", "coo", "president", "chairman"]),
    ("Director-Level", ["director", "vp"]),
    ("Management", ["manager", "supervisor", "lead"]),
    ("Technical Staff", ["engineer", "developer", "architect", "programmer", "analyst"]),
    ("Staff", ["assistant", "coordinator", "specialist", "clerk", "associate"]),
]


def zh_address(t: Column) -> Column:
    cuts = []
    for word in ZH_CUT:
        end = F.instr(t, word) + len(word) - 1
        cuts.append(((F.instr(t, word) > 0) & (end < F.char_length(t)), F.substring(t, F.lit(1), end)))
    return _chain(cuts + [(F.endswith(t, F.lit(x)), F.lit(f"某{x}")) for x in ZH_SUFFIX], F.lit("某地"))


def zh_title(t: Column) -> Column:
    return _chain([(t.rlike("|".join(words)), F.lit(level)) for level, words in ZH_TITLES], F.lit("职员"))


def zh_id_card(t: Column) -> Column:
    return F.when(F.char_length(t) >= 10, F.concat(F.substring(t, 7, 4), F.lit("年出生"))).otherwise("****")


def zh_phone(t: Column) -> Column:
    return F.when(F.char_length(t) >= 3, F.concat(F.left(t, F.lit(3)), F.lit("********"))).otherwise("***")


def en_address(t: Column) -> Column:
    parts = F.transform(F.split(t, ","), lambda x: F.trim(x))
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ", ")).otherwise(t)


def en_title(t: Column) -> Column:
    low = F.lower(t)
    tokens = F.split(low, "[^a-z0-9]+")
    phrases = [(low.rlike("|".join(words)), F.lit(level)) for level, words in EN_PHRASES]
    words = [(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), F.lit(level)) for level, words in EN_TITLES]
    return _chain(phrases + words, F.lit("Employee"))


def en_ssn(t: Column) -> Column:
    return F.when(F.octet_length(t) >= 11, F.concat(F.lit("***-**-"), F.substring(t, 8, 2147483647))).otherwise("***-**-****")


def en_zip(t: Column) -> Column:
    digits = F.regexp_replace(t, "[^0-9]", "")
    return F.when(F.char_length(digits) >= 3, F.concat(F.left(digits, F.lit(3)), F.lit("**"))).otherwise("***")


def en_postcode(t: Column) -> Column:
    parts = F.split(F.trim(t), r"\s+")
    n = F.char_length(t)
    return F.when(F.size(parts) >= 2, F.concat(parts[0], F.lit(" ***"))).when(n > 3, F.concat(F.left(t, n - 3), F.lit(" ***"))).otherwise("*** ***")


def en_phone(t: Column) -> Column:
    n = F.char_length(t)
    half = F.floor(n / 2).cast("int")
    return F.when(n > 6, F.concat(F.left(t, half), F.repeat(F.lit("*"), n - half))).otherwise("***")


def first_and_stars(t: Column) -> Column:
    return F.when(F.char_length(t) > 1, F.concat(F.left(t, F.lit(1)), F.lit("**"))).otherwise("**")


GENERALIZERS = {
    "zh": {"Address": zh_address, "Title": zh_title, "IdCard": zh_id_card, "Phone": zh_phone},
    "en": {"Address": en_address, "Title": en_title, "Ssn": en_ssn, "ZipCode": en_zip, "UkPostcode": en_postcode, "UsPhone": en_phone, "UkPhone": en_phone},
}


def generalize(text: Column, type_key: Column, language: str) -> Column:
    """Less precise text for a type; types a language doesn't know keep their first character."""
    return _chain([(type_key == name, f(text)) for name, f in GENERALIZERS[language].items()], first_and_stars(text))


def splice(text: Column, edits: Column) -> Column:
    """The text with edits (start, end, replaced) made.

    Edits are taken by start, then in their given order; one that begins before the end of the one
    before is skipped; one without a replacement leaves its text.  Offsets beyond the text are cut.
    """
    n = F.char_length(text)
    order = F.transform(edits, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x["end"].alias("end"), x["replaced"].alias("replaced")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s, e = F.least(x["start"], n), F.least(x["end"], n)
        own = F.coalesce(x["replaced"], F.substring(text, s + 1, e - s))
        done = F.struct(e.alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s - a["at"]), own).alias("out"))
        return F.when(x["start"] >= a["at"], done).otherwise(a)

    return F.aggregate(F.array_sort(order), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, n)))


# Full-width digits, letters, blank, brackets and hyphen, one for one.
WIDE = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]) + "　（）－"
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE[:62]) + " ()-"


def normalize_width(text: Column) -> Column:
    return F.translate(text, WIDE, NARROW)

"""The ordered rules of the pattern engine (fixed values; their order is part of the meaning).

Digits and white space are Unicode classes in these rules; ``D`` and ``S`` spell them in a form
that java.util.regex and RE2 read alike.  A boundary is checked on the ASCII neighbours of a match
after matching, so a rejected match still uses up its text.
"""

from __future__ import annotations

from typing import NamedTuple

D = r"\p{Nd}"
S = r"[\t-\r \x{85}\p{Z}]"
S_IN = r"\t-\r \x{85}\p{Z}"

NOT_DIGIT, NOT_ALNUM, ANY = "[0-9]", "[0-9A-Za-z]", None


class Rule(NamedTuple):
    type: str
    pattern: str
    boundary: str | None
    #: A plain test that every match passes, to skip texts cheaply: a literal, or '' for "has a digit".
    guard: str
    check: str | None = None


def unicode_classes(pattern: str) -> str:
    """The pattern with digits and white space spelled as Unicode classes, in brackets and outside."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\d", r"\s"):
            out.append(D if two == r"\d" else S_IN if inside else S)
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def _rules(*rows: tuple) -> list[Rule]:
    return [Rule(row[0], unicode_classes(row[1]), *row[2:]) for row in rows]


# Type, pattern and boundary of each rule, in the order in which they are tried.
ZH = _rules(
    ("IdCard", r"\d{17}[\dXx]", NOT_DIGIT, ""),
    ("CreditCode", r"[0-9A-Z]{2}\d{6}[0-9A-Z]{10}", NOT_ALNUM, ""),
    ("BankCard", r"\d{16,19}", NOT_DIGIT, ""),
    ("Phone", r"1[3-9]\d{9}", NOT_DIGIT, ""),
    ("LandlinePhone", r"0\d{2,3}-?\d{7,8}", NOT_DIGIT, ""),
    ("LandlinePhone", r"(?:400|800)-\d{3,4}-?\d{4}|(?:400|800)\d{3}-\d{4}", NOT_DIGIT, ""),
    ("LicensePlate", r"[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤川青藏琼宁][A-Z][·.]?[A-HJ-NP-Z0-9]{5}", ANY, "zh"),
)
EN = _rules(
    ("Iban", r"[A-Z]{2}\d{2}\s?[A-Z0-9]{4}\s?\d{4}\s?\d{3}[A-Z0-9\s]{0,20}", NOT_ALNUM, ""),
    ("Ssn", r"\d{3}-\d{2}-\d{4}", NOT_DIGIT, ""),
    ("CreditCard", r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}", NOT_DIGIT, "", "luhn"),
    ("UsPhone", r"(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", NOT_DIGIT, ""),
    ("UkPhone", r"(?:\+44[-.\s]?|0)\d{2,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}", NOT_DIGIT, ""),
    ("Passport", r"[A-Z]{1,2}\d{6,9}", NOT_ALNUM, ""),
    ("Passport", r"[A-Z]{1,2}\s\d{6,9}", NOT_ALNUM, ""),
    ("Passport", r"\d{2}[A-Z]{2}\d{5}", NOT_ALNUM, ""),
    ("ZipCode", r"\d{5}(?:-\d{4})?", NOT_DIGIT, ""),
    ("UkPostcode", r"[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}", NOT_ALNUM, ""),
    ("DriversLicense", r"[A-Z]\d{3}-\d{4}-\d{4}", NOT_ALNUM, ""),
    ("DriversLicense", r"[A-Z]{5}\d{6}[A-Z0-9]{2}\d[A-Z]{2}", NOT_ALNUM, ""),
)
COMMON = _rules(
    ("Email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", ANY, "@"),
    ("IpAddress", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", NOT_DIGIT, "", "ipv4"),
    (
        "IpAddress",
        r"(?i:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){6}:[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){5}(?::[0-9a-f]{1,4}){1,2}|(?:[0-9a-f]{1,4}:){4}(?::[0-9a-f]{1,4}){1,3}|(?:[0-9a-f]{1,4}:){3}(?::[0-9a-f]{1,4}){1,4}|(?:[0-9a-f]{1,4}:){2}(?::[0-9a-f]{1,4}){1,5}|(?:[0-9a-f]{1,4}:){1}(?::[0-9a-f]{1,4}){1,6}|(?:[0-9a-f]{1,4}:){1,7}:|:(?::[0-9a-f]{1,4}){1,7})",
        NOT_ALNUM,
        ":",
    ),
)


def rules_for(language: str) -> list[Rule]:
    """Rules of a language ('zh' or 'en') in priority order, then those of all."""
    return {"zh": ZH, "en": EN}[language] + COMMON

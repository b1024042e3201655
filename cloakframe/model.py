"""Types, schemas and default configuration.

A *segment* is a piece of text with a place: file, sheet, row (0 is the header; a paragraph's index
in documents) and column.  An *item* is a span of a segment in code points, end exclusive.
"""

from __future__ import annotations

SEGMENT = "file_id string, sheet_index int, row int, col int, text string"
ITEM = "start int, end int, text string, type string, source string, confidence double"

TYPES = (
    "Email IpAddress Phone IdCard BankCard LandlinePhone LicensePlate CreditCode Ssn CreditCard UsPhone UkPhone "
    "Passport Iban ZipCode UkPostcode DriversLicense PersonName OrgName Address Title"
).split()

MASK, REPLACE, GENERALIZE = "Mask", "Replace", "Generalize"
FAKE, MOU, ORDINAL = "Fake", "Mou", "Ordinal"

#: Strategy of each type in a new workspace (kind, keep_prefix, keep_suffix, style).
DEFAULT_STRATEGIES = {
    "Phone": (MASK, 3, 4, None),
    "IdCard": (MASK, 4, 4, None),
    "BankCard": (MASK, 4, 4, None),
    "Email": (MASK, 1, 0, None),
    "IpAddress": (MASK, 8, 0, None),
    "LandlinePhone": (MASK, 4, 4, None),
    "LicensePlate": (MASK, 2, 2, None),
    "CreditCode": (MASK, 4, 3, None),
    "PersonName": (REPLACE, 0, 0, FAKE),
    "OrgName": (REPLACE, 0, 0, FAKE),
    "Address": (REPLACE, 0, 0, FAKE),
    "Title": (GENERALIZE, 0, 0, None),
    "Custom": (MASK, 1, 1, None),
}
#: What a type without a strategy gets.
FALLBACK_STRATEGY = (MASK, 1, 1, None)
#: Types that a new workspace looks for.
DEFAULT_ENABLED = "Phone IdCard BankCard Email IpAddress LandlinePhone LicensePlate CreditCode PersonName OrgName Address Title".split()
REVERSIBLE = (REPLACE,)


def custom(name: str) -> str:
    """Key of a user's own type."""
    return f"Custom:{name}"


def family(type_key: str) -> str:
    """``Custom`` for all custom types, else the type."""
    return "Custom" if type_key.startswith("Custom:") else type_key

"""Replacement values: numbered pools, "Mou" and ordinal styles, and random formats.

Random parts come from md5(seed | type | text | position), so a value does not depend on where or
when it is made and any engine with md5 can make it again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name and organisation parts that styles look for, and numerals.
COMPOUND_SURNAMES = (
    "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 "
    "太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 闾丘 令狐 百里 呼延 东郭 南门 西门 左丘 第五"
).split()
ORG_SUFFIXES = "检察院 基金会 法院 银行 医院 学校 大学 集团 协会 中心 公司 局 委 所 院 厂".split()
EN_ORG_SUFFIXES = ["Inc.", "Corp.", "LLC", "LLP", "Ltd.", "Group", "Holdings", "Partners", "Associates", "International", "Co."]
STEMS = "甲乙丙丁戊己庚辛壬癸"
NUMERALS = "零一二三四五六七八九十"
ID_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
ID_CHECK = "10X98765432"
REDACTED_CUSTOM = "[已替换]"

# The engine's own pools; a pool is the product of its parts.
POOLS = {
    ("PersonName", "zh"): ("", ["赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许", "明华建国志强秀英丽娜伟芳静磊洋勇艳杰娟涛", "安宁平乐康"]),
    ("PersonName", "en"): (
        " ",
        [
            "Alder Birch Cedar Dale Ember Flint Grove Haven Iris Jasper Lark Maple Nolan Opal Perry Quinn Reed Sage Thorne Vale".split(),
            "Ashford Brook Carver Dunmore Ellery Fenwick Garland Hollis Ingram Kestrel Langley Marlow Norwood Oakes Prescott Ridley Sutton Thayer Upton Whitlock".split(),
        ],
    ),
    ("OrgName", "zh"): ("", ["云峰 海川 天和 金桥 东岳 盛华 恒远 中泰 瑞丰 长青".split(), "科技 贸易 建设 文化 物流 能源 传媒 医药".split(), "公司 集团 中心".split()]),
    ("OrgName", "en"): (" ", ["Northgate Silverline Bluepeak Stonebridge Clearwater Ironwood Redfield Goldcrest Westmark Summitview".split(), "Systems Logistics Energy Media Foods Materials Research Trading".split(), ["Inc.", "LLC", "Ltd.", "Group", "Co."]]),
    ("Address", "zh"): ("", ["东湖区 西山区 南岗区 北辰区 中原区 新城区".split(), "人民路 建设路 和平街 文化路 光明街 解放路 长江路 黄河路".split(), [f"{n}号" for n in range(1, 41)]]),
    ("Address", "en"): (" ", [[str(n) for n in range(101, 141)], ["Oak Street,", "Pine Avenue,", "Lake Road,", "Hill Lane,", "Mill Drive,", "Park Way,"], "Fairview Riverton Greenville Lakeside Milford Ashton".split()]),
    ("Title", "zh"): ("", ["高级 资深 初级 助理 首席".split(), "顾问 分析师 设计师 会计 讲师 编辑".split()]),
    ("Title", "en"): (" ", ["Senior Junior Lead Assistant Principal".split(), "Consultant Analyst Designer Accountant Lecturer Editor".split()]),
}


def pool_size(type_key: str, language: str) -> int:
    return reduce(lambda n, part: n * len(part), POOLS[type_key, language][1], 1)


def _coprime(n: int) -> int:
    from math import gcd

    a = max(1, int(n * 0.618))
    while gcd(a, n) != 1:
        a += 1
    return a


def pooled(type_key: str, language: str, k: Column, seed: int) -> Column:
    """The k-th value (from 0) of a permutation of the pool; a number follows once it is used up."""
    sep, parts = POOLS[type_key, language]
    n = pool_size(type_key, language)
    at = (k % n * _coprime(n) + seed % n) % n
    out, names = at, []
    for part in reversed(parts):
        names.append(F.element_at(F.array(*[F.lit(x) for x in part]), (out % len(part) + 1).cast("int")))
        out = F.floor(out / len(part))
    turn = F.floor(k / n)
    suffix = F.when(turn > 0, F.concat(F.lit(sep if language == "en" else ""), (turn + 1).cast("string"))).otherwise("")
    return F.concat(F.concat_ws(sep, *reversed(names)), suffix)


def numeral(n: Column) -> Column:
    """Chinese words for 0 to 99, digits above."""
    digit = lambda x: F.substring(F.lit(NUMERALS), (x + 1).cast("int"), F.lit(1))
    ones, tens = n % 10, F.floor(n / 10)
    tail = F.when(ones == 0, "").otherwise(digit(ones))
    return F.when(n >= 100, n.cast("string")).when(n <= 10, digit(n)).when(n < 20, F.concat(F.lit("十"), tail)).otherwise(F.concat(digit(tens), F.lit("十"), tail))


def text_language(text: Column) -> Column:
    """zh if a text is empty or has a CJK ideograph (U+4E00 to U+9FFF), else en."""
    return F.when((text == "") | text.rlike("[一-鿿]"), "zh").otherwise("en")


def surname(text: Column) -> Column:
    two = F.left(text, F.lit(2))
    return F.when((F.char_length(text) >= 2) & two.isin(COMPOUND_SURNAMES), two).otherwise(F.left(text, F.lit(1)))


def _suffix(text: Column, suffixes: list[str], default: str) -> Column:
    return reduce(lambda acc, s: F.when(F.endswith(text, F.lit(s)), s).otherwise(acc), reversed(suffixes), F.lit(default))


def org_suffix(text: Column) -> Column:
    return _suffix(text, ORG_SUFFIXES, "单位")


def en_org_suffix(text: Column) -> Column:
    return _suffix(text, EN_ORG_SUFFIXES, "Co.")


NUMBERED = ["PersonName", "OrgName", "Address", "Title"]


def bucket(text: Column, type_key: Column, style: Column) -> Column:
    """The counter that numbers an entity; null for types whose values need no number."""
    lang = text_language(text)
    zh = lang == "zh"
    mou = F.when(type_key == "PersonName", F.when(zh, F.concat(F.lit("mou_name_"), surname(text))).otherwise("mou_name_en")).when(type_key == "OrgName", F.when(zh, F.concat(F.lit("mou_org_"), org_suffix(text))).otherwise(F.concat(F.lit("mou_org_en_"), en_org_suffix(text)))).otherwise(F.concat(F.lit("mou_"), type_key, F.lit("_"), lang))
    ordinal = F.when(zh, F.concat(F.lit("ordinal_"), type_key)).otherwise(F.concat(type_key, F.lit("_en")))
    return F.when(type_key.isin(NUMBERED), F.when(style == "Mou", mou).when(style == "Ordinal", ordinal).otherwise(F.concat(type_key, F.lit("_"), lang)))


def numbered_value(text: Column, type_key: Column, style: Column, k: Column, seed: int) -> Column:
    """Value of an entity that is the k-th (from 0) of its bucket."""
    zh = text_language(text) == "zh"
    n = k + 1
    some = F.when(k > 0, numeral(n)).otherwise("")
    some_en = F.when(k > 0, F.concat(F.lit(" "), n.cast("string"))).otherwise("")
    doe = F.concat(F.when(k % 2 == 0, "John Doe").otherwise("Jane Doe"), F.when(k >= 2, F.concat(F.lit(" "), (F.floor(k / 2) + 1).cast("string"))).otherwise(""))
    mou = {
        "PersonName": F.when(zh, F.when(text == "", "某某").otherwise(F.concat(surname(text), F.lit("某"), some))).otherwise(doe),
        "OrgName": F.when(zh, F.concat(F.lit("某"), some, org_suffix(text))).otherwise(F.concat(F.lit("Acme "), en_org_suffix(text), some_en)),
        "Address": F.when(zh, F.concat(F.lit("某地"), some)).otherwise(F.when(k == 0, "[REDACTED CITY]").otherwise(F.concat(F.lit("[REDACTED CITY"), some_en, F.lit("]")))),
        "Title": F.when(zh, F.concat(F.lit("某职务"), some)).otherwise(F.when(k == 0, "[REDACTED TITLE]").otherwise(F.concat(F.lit("[REDACTED TITLE"), some_en, F.lit("]")))),
    }
    stem = F.when(k < 10, F.substring(F.lit(STEMS), n.cast("int"), F.lit(1))).otherwise(n.cast("string"))
    ordinal = {
        "PersonName": F.concat(F.lit("当事人"), numeral(n)),
        "OrgName": F.concat(stem, org_suffix(text)),
        "Address": F.concat(F.lit("地址"), numeral(n)),
        "Title": F.concat(F.lit("职务"), numeral(n)),
    }
    out = F.lit(None).cast("string")
    for t in NUMBERED:
        fake = F.when(zh, pooled(t, "zh", k, seed)).otherwise(pooled(t, "en", k, seed))
        own = F.when(style == "Mou", mou[t]).when((style == "Ordinal") & zh, ordinal[t]).otherwise(fake)
        out = F.when(type_key == t, own).otherwise(out)
    return out


class Draw:
    """Random parts of one text as SQL expressions, for Spark or DuckDB."""

    def __init__(self, seed: int, type_key: str, text: str, duck: bool = False):
        self.base, self.duck, self.at = f"concat('{seed}|{type_key}|', {text}, '|', ", duck, 0

    def number(self, lo: int, hi: int) -> str:
        """A whole number from lo up to hi, hi not included."""
        self.at += 1
        wide = hi - lo > 1 << 31
        h = f"substr(md5({self.base}'{self.at}')), 1, {15 if wide else 8})"
        value = f"('0x' || {h})::BIGINT" if self.duck else f"cast(conv({h}, 16, 10) as bigint)"
        return f"({lo} + {value} % {hi - lo})"

    def pick(self, items: list[str] | str) -> str:
        inner = ", ".join(f"'{x}'" for x in items)
        at = f"cast(1 + {self.number(0, len(items))} as int)"
        return f"list_extract([{inner}], {at})" if self.duck else f"element_at(array({inner}), {at})"

    def digits(self, lo: int, hi: int, width: int) -> str:
        kind = "varchar" if self.duck else "string"
        return f"lpad(cast({self.number(lo, hi)} as {kind}), {width}, '0')"

    def letter(self) -> str:
        return self.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


PHONE_PREFIXES = "130 131 132 133 135 136 137 138 139 150 151 152 155 158 159 186 187 188 189 199".split()
CARD_PREFIXES = "622202 622848 622700 622588 621661 622260 621483 622155".split()
AREAS = "110101 310101 440103 440305 330102 320102 510104 420102".split()
LANDLINES = "010 021 020 0755 0571 025 028 027".split()
CREDIT_CHARS = "0123456789ABCDEFGHJKLMNPQRTUWXY"
MAIL_NAMES = "lin chen sun gao luo tang deng feng peng zeng".split()
MAIL_DOMAINS = "example.com example.net example.org mail.example".split()


def id_check_digit(id17: str, duck: bool = False) -> str:
    """ISO 7064 mod 11-2 check character of 17 digits, as SQL."""
    total = " + ".join(f"cast(substr({id17}, {k + 1}, 1) as int) * {w}" for k, w in enumerate(ID_WEIGHTS))
    return f"substr('{ID_CHECK}', cast(({total}) % 11 + 1 as int), 1)"


def random_format(type_key: str, text: str, seed: int, duck: bool = False) -> str | None:
    """SQL for a random value in a type's format; None for types without one."""
    d = Draw(seed, type_key, text, duck)
    if type_key == "Phone":
        parts = [d.pick(PHONE_PREFIXES), d.digits(10_000_000, 99_999_999, 8)]
    elif type_key == "IdCard":
        body = "concat(" + ", ".join([d.pick(AREAS), d.digits(1960, 2000, 4), d.digits(1, 13, 2), d.digits(1, 29, 2), d.digits(100, 999, 3)]) + ")"
        parts = [body, id_check_digit(body, duck)]
    elif type_key == "BankCard":
        n = f"(case when length({text}) between 16 and 19 then length({text}) else 16 end)"
        parts = [f"substr(concat({d.pick(CARD_PREFIXES)}, {d.digits(0, 10**7, 7)}, {d.digits(0, 10**7, 7)}), 1, cast({n} as int))"]
    elif type_key == "Email":
        parts = [d.pick(MAIL_NAMES), d.digits(100, 999, 3), "'@'", d.pick(MAIL_DOMAINS)]
    elif type_key == "IpAddress":
        kind = "varchar" if duck else "string"
        n = [f"cast({d.number(lo, hi)} as {kind})" for lo, hi in ((10, 200), (0, 256), (0, 256), (1, 255))]
        parts = [n[0], "'.'", n[1], "'.'", n[2], "'.'", n[3]]
    elif type_key == "LandlinePhone":
        parts = [d.pick(LANDLINES), "'-'", d.digits(60_000_000, 89_999_999, 8)]
    elif type_key == "LicensePlate":
        parts = [d.pick("京沪粤浙苏川鄂鲁"), d.pick("ABCDEFGHJKLMNPQRSTUVWXYZ"), d.digits(10_000, 99_999, 5)]
    elif type_key == "CreditCode":
        parts = ["'91'", d.pick(AREAS), *[d.pick(CREDIT_CHARS) for _ in range(10)]]
    elif type_key == "Ssn":
        parts = [d.digits(100, 899, 3), "'-'", d.digits(10, 99, 2), "'-'", d.digits(1000, 9999, 4)]
    elif type_key == "CreditCard":
        parts = ["'4'", d.digits(0, 999_999_999_999_999, 15)]
    elif type_key == "UsPhone":
        parts = ["'('", d.digits(200, 999, 3), "') '", d.digits(200, 999, 3), "'-'", d.digits(1000, 9999, 4)]
    elif type_key == "UkPhone":
        parts = ["'+44 '", d.digits(1000, 9999, 4), "' '", d.digits(100_000, 999_999, 6)]
    elif type_key == "Passport":
        parts = [d.letter(), d.digits(10_000_000, 99_999_999, 8)]
    elif type_key == "Iban":
        parts = ["'GB'", d.digits(10, 99, 2), "'BANK'", d.digits(10**13, 10**14 - 1, 14)]
    elif type_key == "ZipCode":
        parts = [d.digits(10_000, 99_999, 5)]
    elif type_key == "UkPostcode":
        parts = [d.letter(), d.letter(), d.digits(1, 9, 1), "' '", d.digits(1, 9, 1), d.letter(), d.letter()]
    elif type_key == "DriversLicense":
        parts = [d.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(12)]
    else:
        return None
    return "concat(" + ", ".join(parts) + ")"


RANDOM_TYPES = "Phone IdCard BankCard Email IpAddress LandlinePhone LicensePlate CreditCode Ssn CreditCard UsPhone UkPhone Passport Iban ZipCode UkPostcode DriversLicense".split()


def random_value(type_key: Column, text: str, seed: int) -> Column:
    """Random value for a text column by its type; custom types get a constant."""
    out = F.lit(REDACTED_CUSTOM)
    for t in RANDOM_TYPES:
        out = F.when(type_key == t, F.expr(random_format(t, text, seed))).otherwise(out)
    return out

"""What is known of code points: categories and names of Unicode 15.0, kinds, and emoji.

Columns of code points are classified in the JVM: the kinds that need no category by comparison, the others by a
small table that is broadcast (its size doesn't depend on the data).
"""

from __future__ import annotations

import itertools
import json
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNICODE_VERSION, EMOJI_VERSION = "15.0.0", "17.0"
#: Code points that Python's Unicode 15.1 has beyond 15.0.
LATER = ((0x2EBF0, 0x2EE5D), (0x2FFC, 0x2FFF), (0x31EF, 0x31EF))
#: White space, and the ranges of kinds that need no category, first match first.
SPACES = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
PLAIN_SPACES = (0x09, 0x0A, 0x0D, 0x20)
KIND_RANGES = (
    ("zero_width", ((0x200B, 0x200D), (0x2060, 0x2064), (0xFEFF, 0xFEFF))),
    ("bidi_control", ((0x061C, 0x061C), (0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069))),
    ("variation_selector", ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))),
    ("tag", ((0xE0000, 0xE007F),)),
    ("soft_hyphen", ((0xAD, 0xAD),)),
)
REMOVABLE = tuple(kind for kind, _ in KIND_RANGES)
KINDS = (*REMOVABLE, "unusual_whitespace", "control", "combining")
KEYCAP_BASES = "#*0123456789"
KEYCAP, EMOJI_STYLE = 0x20E3, 0xFE0F


def category(cp: int) -> str:
    """The general category in Unicode 15.0."""
    return "Cn" if any(a <= cp <= b for a, b in LATER) else unicodedata.category(chr(cp))


def name(cp: int, otherwise: str) -> str:
    """The name in Unicode 15.0; controls, private and unassigned code points have the other one."""
    return otherwise if category(cp) in ("Cc", "Cn", "Co", "Cs") else unicodedata.name(chr(cp), otherwise)


def is_space(cp: int) -> bool:
    return cp in SPACES


def is_letter(cp: int) -> bool:
    return category(cp)[0] == "L"


def is_word(cp: int) -> bool:
    """Letters, numbers and the underscore; marks are none."""
    return cp == 0x5F or category(cp)[0] in "LN"


def kind_of(cp: int) -> str:
    for kind, ranges in KIND_RANGES:
        if any(a <= cp <= b for a, b in ranges):
            return kind
    if cp in SPACES:
        return "" if cp in PLAIN_SPACES else "unusual_whitespace"
    of = category(cp)
    if of in ("Cc", "Cf"):
        return "control"
    return "combining" if of[0] == "M" else ""


@cache
def kind_rows() -> tuple[tuple[int, str, str, str], ...]:
    """Code point, kind, category and name of all that have a kind."""
    return tuple((cp, k, category(cp), name(cp, "UNNAMED CONTROL")) for cp in range(0x110000) if not 0xD800 <= cp < 0xE000 and (k := kind_of(cp)))


@cache
def _json(table: str) -> str:
    return json.dumps(_TABLES[table][0]())


def _constant(spark: SparkSession, table: str) -> DataFrame:
    """A table of fixed size, to be broadcast; it stands in the plan as a constant, so no task has to send it."""
    schema = _TABLES[table][1]
    names = [x.split()[0] for x in schema.split(", ")]
    values = F.from_json(F.lit(_json(table)), "array<array<string>>")
    each = spark.range(1).select(F.explode(values).alias("r"))
    return F.broadcast(each.select(*(F.col("r")[k].cast(x.split()[1]).alias(n) for k, (n, x) in enumerate(zip(names, schema.split(", "), strict=True)))))


def kinds(spark: SparkSession) -> DataFrame:
    """cp, kind, category, name: about three thousand rows, to be broadcast."""
    return _constant(spark, "kinds")


def ranges(points: list[int]) -> list[tuple[int, int]]:
    """Ascending code points as inclusive ranges."""
    out: list[tuple[int, int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


#: Where the parts of an expression's character class begin: characters of one part aren't held against ranges of another.
_PARTS = (0x80, 0x100, 0x300, 0x370, 0x600, 0xC00, 0x1400, 0x2000, 0x2070, 0x3000, 0xA000, 0xD800, 0x10000, 0x12000, 0x1F000, 0x20000, 0xE0000, 0x110000)


def java_class(points: list[int], negated: bool = False) -> str:
    """A Java regular expression of one character of these code points.

    Those beyond ASCII stand in intersections with a part of the code space each, so a character is held against the parts
    and the ranges of its own, not against hundreds of ranges.
    """
    told = lambda some: "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges(some))
    out = told([p for p in points if p < 0x80])
    for first, end in itertools.pairwise(_PARTS):
        if own := [p for p in points if first <= p < end]:
            out += f"[\\x{{{first:X}}}-\\x{{{end - 1:X}}}&&[{told(own)}]]"
    return "[" + "^" * negated + out + "]"


@cache
def kind_class() -> str:
    """Matches one character that has a kind."""
    return java_class([cp for cp, *_ in kind_rows()])


@cache
def space_class(negated: bool = False) -> str:
    return java_class(list(SPACES), negated)


@cache
def removable_class() -> str:
    return java_class([p for _, found in KIND_RANGES for a, b in found for p in range(a, b + 1)])


@cache
def word_points() -> tuple[int, ...]:
    return tuple(cp for cp in range(0x110000) if not 0xD800 <= cp < 0xE000 and is_word(cp))


@cache
def word_inside() -> str:
    """What is_word() accepts, to stand between brackets of a Java expression."""
    return java_class(list(word_points()))[1:-1]


def code_point(char: Column) -> Column:
    """The code point of a one-character string."""
    return F.ascii(char)


def kind(cp: Column) -> Column:
    """The kinds that comparison alone can tell: all but control and combining, which the table of kinds() adds."""
    out = None
    for label, found in KIND_RANGES:
        hit = None
        for a, b in found:
            one = cp.between(a, b)
            hit = one if hit is None else hit | one
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.when(cp.isin(*[p for p in SPACES if p not in PLAIN_SPACES]), "unusual_whitespace")


def removable(cp: Column) -> Column:
    return F.coalesce(kind(cp).isin(*REMOVABLE), F.lit(False))


def label(cp: Column) -> Column:
    """U+ and at least four hexadecimal digits."""
    digits = F.hex(cp.cast("long"))
    return F.concat(F.lit("U+"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")))


#: Code points with the property Emoji in version 17.0.
EMOJI = (
    "23 2A 30-39 A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE "
    "2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 "
    "267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA "
    "26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 "
    "2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A "
    "1F1E6-1F1FF 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 "
    "1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 "
    "1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D8 1F6DC-1F6E5 1F6E9 "
    "1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FA8A 1FA8E-1FAC6 1FAC8 1FACD-1FADC "
    "1FADF-1FAEA 1FAEF-1FAF8"
)


@cache
def emoji_points() -> tuple[int, ...]:
    out: list[int] = []
    for part in EMOJI.split():
        a, _, b = part.partition("-")
        out += range(int(a, 16), int(b or a, 16) + 1)
    return tuple(out)


@cache
def special_class() -> str:
    """What one character that has a kind or the property Emoji matches, to stand between brackets; bases of keycaps aside."""
    return java_class(sorted({cp for cp, *_ in kind_rows()} | {p for p in emoji_points() if chr(p) not in KEYCAP_BASES}))[1:-1]


def _special_rows() -> list[tuple]:
    rows = {cp: (cp, kind, title, False) for cp, kind, _, title in kind_rows()}
    for cp in emoji_points():
        rows[cp] = (cp, rows[cp][1] if cp in rows else None, name(cp, "NAME UNAVAILABLE IN RUNTIME UNICODE DATABASE"), True)
    return sorted(rows.values(), key=lambda r: r[0])


def specials(spark: SparkSession) -> DataFrame:
    """cp, kind (null without one), name, is_emoji: about four thousand rows, to be broadcast."""
    return _constant(spark, "specials")


def changes_in_nfkc(cp: int) -> bool:
    return not unicodedata.is_normalized("NFKC", chr(cp))


@cache
def unstable_class() -> str:
    """Matches a character that a normal form may change or that may change with the one before it: a text without any is in all normal forms."""
    second = {ord(d[-1]) for cp in range(0x110000) if not 0xD800 <= cp < 0xE000 and len(d := unicodedata.normalize("NFD", chr(cp))) > 1}
    jamo = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    return java_class([cp for cp in range(0x110000) if not 0xD800 <= cp < 0xE000 and (cp in second or cp in jamo or unicodedata.combining(chr(cp)) or not unicodedata.is_normalized("NFKC", chr(cp)) or not unicodedata.is_normalized("NFC", chr(cp)))])


def scripts(spark: SparkSession) -> DataFrame:
    """cp, script (the first word of its name) of letters: to be broadcast."""
    return _constant(spark, "scripts")


def _script_rows() -> list[tuple]:
    return [(cp, name(cp, "").split(" ")[0]) for cp in word_points() if is_letter(cp) and not (0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0x17000 <= cp < 0x18D09 or 0x20000 <= cp < 0x323B0)]


_TABLES = {
    "kinds": (kind_rows, "cp int, kind string, category string, name string"),
    "specials": (_special_rows, "cp int, kind string, name string, is_emoji boolean"),
    "scripts": (_script_rows, "cp int, script string"),
}

"""Text and bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a BIGINT."""
    data = F.transform(F.filter(F.split(F.regexp_replace(F.hex(s.cast("binary")), "(..)", "$1,"), ","), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("bigint"))
    return F.aggregate(data, F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(4294967295))


def same_ignoring_case(a: Column, b: Column) -> Column:
    """Equal but for the case of ASCII letters."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(a, up, low) == F.translate(b, up, low)


def find_any(s: Column, characters: str) -> Column:
    """1-based place of the first of some characters, 0 if none."""
    return F.regexp_instr(s, F.lit("[" + re.escape(characters) + "]"))


def find_not_in(s: Column, characters: str) -> Column:
    return F.regexp_instr(s, F.lit("[^" + re.escape(characters) + "]"))


def read_decimal(s: Column, signed: bool = False) -> Column:
    """The decimal number that s begins with, NULL if none; unsigned unless signed."""
    head = F.regexp_extract(s, "^(-?[0-9]+)" if signed else "^([0-9]+)", 1)
    return head.try_cast("bigint" if signed else "decimal(20,0)")


def read_to(s: Column, delimiter: str, or_end: bool = False) -> Column:
    """What stands before the delimiter; without one NULL, or all of s with or_end."""
    found = F.when(s.contains(delimiter), F.substring_index(s, delimiter, 1))
    return F.coalesce(found, s) if or_end else found


def read_in_set(s: Column, characters: str) -> Column:
    """The characters that s begins with, as far as they are of the set."""
    return F.regexp_extract(s, "^[" + re.escape(characters) + "]*", 0)


def write_hex(x: Column) -> Column:
    """Bytes, text or a number in lower-case hexadecimal."""
    return F.lower(F.hex(x))


def read_hex(s: Column) -> Column:
    """The unsigned hexadecimal number that s begins with, NULL if none or if it has over 16 digits."""
    head = F.regexp_extract(s, "^([0-9A-Fa-f]+)", 1)
    return F.when(F.length(head).between(1, 16), F.conv(head, 16, 10).cast("decimal(20,0)"))


def decode_hex(s: Column) -> Column:
    """The bytes of hexadecimal digits, with white space between them or not; NULL for anything else."""
    bare = F.regexp_replace(s, r"\s+", "")
    return F.when(bare.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.unhex(bare))


def decode_base64(s: Column) -> Column:
    """The bytes of base64 text; NULL for anything else."""
    return F.try_to_binary(s, F.lit("base64"))


def can_be_bare_key(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")


def can_be_shared_key(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z0-9_-]*$") & (F.octet_length(s) <= 16)


def escape_json(s: Column) -> Column:
    """A JSON string literal: quotes, backslashes, newlines, returns and tabs are escaped by letter, the other
    control characters and 0x7f as \\u00xx."""
    plain = F.to_json(F.array(s)).substr(F.lit(2), F.length(F.to_json(F.array(s))) - 2)
    for letter, code in (("b", "0008"), ("f", "000c")):
        plain = F.regexp_replace(plain, rf"(?<!\\)((?:\\\\)*)\\{letter}", rf"$1\\u{code}")
    low = plain
    for digit in "ABCDEF":
        low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    plain = F.when(plain.rlike(r"\\u00[01][A-F]"), low).otherwise(plain)
    return F.replace(plain, F.lit("\x7f"), F.lit("\\u007f"))

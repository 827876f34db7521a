"""Canonical spellings of hosts, guids, logon ids and numbers, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The characters that count as white space.
BLANKS = "".join(
    map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)

#: Logon ids of built-in accounts, as canonical hexadecimal numbers.
BUILT_IN_LOGONS = ("0", "3e7", "3e4", "3e5")


def strip(c: Column) -> Column:
    """Without surrounding white space; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def host_key(c: Column) -> Column:
    """Short host name in lower case; null where missing or blank."""
    return F.nullif(strip(F.lower(F.substring_index(strip(c), ".", 1))), F.lit(""))


def guid_key(c: Column) -> Column:
    """The 32 hexadecimal digits in lower case; null where missing, malformed or all zero."""
    bare = F.translate(F.lower(c), "{}()-" + BLANKS, "")
    return F.when(bare.rlike("^[0-9a-f]{32}$") & (bare != "0" * 32), bare)


def logon_key(c: Column) -> Column:
    """Hexadecimal digits without prefix and leading zeros; null where missing, malformed or a built-in account."""
    digits = F.regexp_extract(F.lower(strip(c)), "^(?:0x)?0*([0-9a-f]+)$", 1)
    return F.when((digits != "") & ~digits.isin(*BUILT_IN_LOGONS), digits)


def number_key(c: Column) -> Column:
    """The number a text spells, as decimal(38,6); null where it spells none."""
    return strip(c).try_cast("decimal(38,6)")


def first_logon(raw: Column) -> Column:
    """First usable logon id of a raw record."""
    return F.coalesce(*(logon_key(raw[k]) for k in ("TargetLogonId", "LogonId", "SubjectLogonId")))


def name_key(c: Column, none: tuple[str, ...] = ("", "unknown", "n/a")) -> Column:
    """A name without surrounding blanks and case; null for the spellings that name nothing."""
    k = F.lower(strip(c))
    return F.when(~k.isin(*none), k)


def program_key(c: Column) -> Column:
    """File name after the last slash or backslash, without surrounding blanks and case; null where empty."""
    return F.nullif(F.lower(strip(F.regexp_extract(c, r"([^/\\]*)$", 1))), F.lit(""))

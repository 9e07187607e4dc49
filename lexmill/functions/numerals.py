"""Roman and ordinal numerals as lookups: canonical numerals are unique, so a string is valid exactly if the table has it."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
_TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]


def roman(n: int) -> str:
    return "C" * (n // 100) + _TENS[n // 10 % 10] + _UNITS[n % 10]


def ordinal_words(most: int = 49) -> dict[str, int]:
    """English ordinals up to `most`, compounds with a blank."""
    small = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
    out = {w: i + 1 for i, w in enumerate(small)}
    for ten, stem, full in ((20, "twenty", "twentieth"), (30, "thirty", "thirtieth"), (40, "forty", "fortieth")):
        out[full] = ten
        out |= {f"{stem} {w}": ten + i + 1 for i, w in enumerate(small[:9])}
    return {w: n for w, n in out.items() if n <= most}


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())), key)


def parse_roman(text: Column, most: int = 60) -> Column:
    """The numeral before the first point, other letters dropped: canonical and at most `most`, else null."""
    from .text import ACCENTED, PLAIN

    head = F.upper(F.translate(F.regexp_extract(text, r"^([^.]*)", 1), ACCENTED, PLAIN))
    return _lookup({roman(n): n for n in range(1, most + 1)}, F.regexp_replace(head, r"[^IVXLC]", ""))


def parse_numeral(text: Column, most: int = 200) -> Column:
    """A roman or arabic numeral; a 1 before other numerals is read as I. At most `most`, else null."""
    kept = F.regexp_replace(F.upper(text), r"[^IVXLC0-9]", "")
    mended = F.regexp_replace(F.regexp_replace(kept, r"^1(?=[VXLCI])", "I"), r"[0-9]", "")
    number = F.try_to_number(kept, F.lit("999999")).cast("int")
    arabic = F.when(number.between(1, most), number)
    return F.when(kept.rlike(r"^[0-9]{1,6}$"), arabic).otherwise(_lookup({roman(n): n for n in range(1, most + 1)}, mended))


def parse_ordinal(text: Column) -> Column:
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z]+", " "), r"\bthe\b", " "))
    return _lookup(ordinal_words(), F.regexp_replace(words, r"\s+", " "))

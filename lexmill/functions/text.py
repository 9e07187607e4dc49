"""Text expressions that stay inside the JVM, each with the SQL that says the same."""

from __future__ import annotations

import unicodedata as ud

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters with one plain ASCII letter or digit behind them, by compatibility decomposition without marks."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)]:
        plain = "".join(c for c in ud.normalize("NFKD", chr(cp)) if not ud.combining(c))
        if len(plain) == 1 and plain != chr(cp) and plain.isascii() and plain.isalnum():
            pairs.append((chr(cp), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def fold(text: Column) -> Column:
    """Lower case without accents, so that spellings with and without marks compare equal. Hyphens and spaces stay. Null stays null."""
    return F.lower(F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}+", ""))


def fold_sql(text: str) -> str:
    return f"lower(regexp_replace(translate({text}, '{ACCENTED}', '{PLAIN}'), '\\p{{Mn}}+', '', 'g'))"


def tokens(text: Column) -> Column:
    """The runs of ASCII letters and digits of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(r"([a-z0-9]+)"), F.lit(1))


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({fold_sql(text)}, '[a-z0-9]+')"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def squeezed(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0b]+", " "))


def squeezed_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '[ \\t\\r\\n\\f\\x0b]+', ' ', 'g'), '^ | $', '', 'g')"


# Spoken forms of terms; case is not kept.
SPOKEN = {"vata": "vaata", "vatas": "vaatas", "pitta": "pitta", "pittas": "pittas", "kapha": "kaafa", "kaphas": "kaafas", "agni": "aagni", "dosha": "dosha", "doshas": "doshas"}


def spoken(text: Column) -> Column:
    """Whole words replaced by how they are spoken, whatever their case."""
    for word, said in SPOKEN.items():
        text = F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])", said)
    return text


def lines(text: Column) -> Column:
    """The lines of a text under every line break that Unicode knows; a final break opens no line."""
    parts = F.array(F.split(text, r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85\x{2028}\x{2029}]"))
    last_dropped = lambda p: F.when((F.size(p) > 0) & (F.element_at(p, -1) == ""), F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return F.get(F.transform(parts, last_dropped), 0)  # a lambda's argument is split once, a column at each use

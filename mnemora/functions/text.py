"""Text normal forms as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORD_ID_PATTERN = r"^[a-z0-9][a-z0-9-]{2,127}$"
_EDGE_SPACE = r"(?U)^[\s﻿]+|[\s﻿]+$"
_INNER_SPACE = r"(?U)[\s﻿]+"
_QUOTES = "[\"'“”‘’`]"
# The white space of ASCII that the patterns above match.
_ASCII_SPACE = " \t\n\x0b\x0c\r"


def _composed(col: Column) -> Column:
    """NFKC by the Unicode library that Spark comes with, inside the JVM; it takes no null."""
    called = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col, F.lit(True))
    return F.when(col.isNotNull(), called)


def is_ascii(col: Column) -> Column:
    """Every character takes one byte: lengths are compared, no character is looked at."""
    return F.octet_length(col) == F.char_length(col)


def trim_all(col: Column) -> Column:
    """Trim every Unicode space and the byte-order mark, not only U+0020."""
    return F.regexp_replace(col, _EDGE_SPACE, "")


def nfkc(col: Column) -> Column:
    """NFKC. ASCII values keep their text."""
    return F.when(is_ascii(col), col).otherwise(_composed(col))


def clean_items(col: Column) -> Column:
    """``clean_text`` for every element."""
    return F.transform(col, clean_text)


def clean_text(col: Column) -> Column:
    """NFKC and trim; blank becomes null. ASCII texts need no pattern; ``col`` is read often, so it should be a plain column."""
    plain, other = F.btrim(col, F.lit(_ASCII_SPACE)), trim_all(_composed(col))
    return F.when(is_ascii(col), F.when(plain != "", plain)).otherwise(F.when(other != "", other))


def clean_columns(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds ``clean_text`` of each of ``columns`` under its name."""
    return rows.withColumns({name: clean_text(col) for name, col in columns.items()})


def collapse_spaces(col: Column) -> Column:
    return F.regexp_replace(col, _INNER_SPACE, " ")


def _plain_headword(col: Column, dropped: str = "") -> Column:
    """An ASCII text without the characters ``dropped``, its spaces collapsed and trimmed, in lower case: no pattern but for runs of spaces."""
    spaced = F.translate(col, _ASCII_SPACE + dropped, " " * len(_ASCII_SPACE))
    single = F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " +", " ")).otherwise(spaced)
    return F.lower(F.btrim(single))


def identity_headword(col: Column) -> Column:
    """Headword form of the identity map: quotes dropped, spaces collapsed, lower case."""
    return quoteless(clean_text(col))


def quoteless(cleaned: Column) -> Column:
    """``identity_headword`` of a text that is cleaned already."""
    bare = F.regexp_replace(cleaned, _QUOTES, "")
    text = F.when(is_ascii(cleaned), _plain_headword(cleaned, "\"'`")).otherwise(F.lower(trim_all(collapse_spaces(bare))))
    return F.when(text != "", text)


def relation_headword(col: Column) -> Column:
    """Headword form of relation lookups: spaces collapsed, lower case, quotes kept."""
    return F.when(is_ascii(col), _plain_headword(col)).otherwise(F.lower(trim_all(collapse_spaces(_composed(col)))))


def corpus_headword(col: Column) -> Column:
    """Headword form of the corpus index: trimmed and lower case only."""
    return F.lower(F.when(is_ascii(col), F.btrim(col, F.lit(_ASCII_SPACE))).otherwise(trim_all(_composed(col))))


def is_word_id(col: Column) -> Column:
    return col.rlike(WORD_ID_PATTERN)


def bounded(col: Column, limit: int) -> Column:
    """Null when blank or longer than ``limit``."""
    return F.when((F.length(col) > 0) & (F.length(col) <= limit), col)


def bare_key(col: Column) -> Column:
    """Key form used to spot secrets and markers: alphanumerics only, lower case."""
    return F.lower(F.regexp_replace(col, "[^A-Za-z0-9]", ""))

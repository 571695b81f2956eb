"""Text expressions shared by the operators; all are built-in Spark functions.

Each has its twin for DuckDB beside it.  Where a text is split into words or lines, let
the result be a column of its own before it goes into a lambda function: an expression
inside a lambda is evaluated for every element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signals of damaged or editorial text, as (name, pattern); Java and RE2 read
# them alike, but for the apostrophe that SQL doubles.
OCR_PATTERNS = (
    ("replacement_character", "�"),
    ("transcriber_or_editor_note", r"(?i)\[(?:transcriber|editor)'?s? note|transcriber's note"),
    ("gutenberg_boilerplate", r"(?i)project gutenberg|end of (?:the )?project gutenberg"),
    ("broken_line_hyphenation", r"[A-Za-z]{2,}-\n[A-Za-z]{2,}"),
    ("suspicious_markup_glyph", r"[{}<>|]"),
    ("digit_intrusion", r"\b[A-Za-z]+\d+[A-Za-z\d]*\b|\b\d+[A-Za-z]+[A-Za-z\d]*\b"),
)

# White space as Python's str.strip and str.split see it, and its line breaks.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
SPACE = r"[\x09-\x0D\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NO_SPACE = "[^" + SPACE[1:]
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def body(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words of the canonical normalisation: case-folded runs of a-z and 0-9."""
    return F.regexp_extract_all(F.replace(F.lower(body(text)), F.lit("ß"), F.lit("ss")), F.lit("[a-z0-9]+"), F.lit(0))


def normalized(text: Column) -> Column:
    return F.array_join(words(text), " ")


def text_hash(text: Column) -> Column:
    return F.sha2(normalized(text).cast("binary"), 256)


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space, counted by their ends."""
    shrunk = F.regexp_replace(body(text), r"[^\x20\x09-\x0D]+", "x")
    return (F.length(shrunk) - F.length(F.replace(shrunk, F.lit("x"), F.lit("")))).cast("long")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def split_words(text: Column) -> Column:
    """Words as Python's split sees them."""
    return F.regexp_extract_all(body(text), F.lit(f"{NO_SPACE}+"), F.lit(0))


def split_lines(text: Column) -> Column:
    """Lines as Python's splitlines sees them: a break at the end opens no line."""
    parts = F.split(body(text), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def count_of(text: Column, char_class: str) -> Column:
    """How many characters are of a class, by what is left without them."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{char_class}+", ""))


def grams(w: Column, width: int) -> Column:
    """All runs of ``width`` words, repeats included; fewer words give none."""
    many = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.array_join(F.slice(w, i, width), " "))
    return F.when(F.size(w) >= width, many).otherwise(F.array().cast("array<string>"))


def shingles(w: Column, width: int) -> Column:
    """Distinct shingles of a word array; a shorter text is one shingle, no words none."""
    one = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(w) >= width, F.array_distinct(grams(w, width))).otherwise(one)


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(body(text), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))), lambda x: x != "")


def hash64(value: Column) -> Column:
    """60 leading bits of a SHA-256 as a long, alike in both engines."""
    return F.conv(F.substring(F.sha2(value.cast("binary"), 256), 1, 15), 16, 10).cast("long")


#: The same expressions for DuckDB.
SQL_WORDS = "regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[a-z0-9]+')"
SQL_HASH = f"sha256(array_to_string({SQL_WORDS}, ' '))"
SQL_COUNT = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT"
SQL_LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '')"


def sql_string(s: str) -> str:
    """A literal for DuckDB; control and other odd characters by their number."""
    parts, plain = [], ""
    for c in s:
        if c.isprintable() and c != "'":
            plain += c
        else:
            parts += [f"'{plain}'"] * bool(plain) + [f"chr({ord(c)})"]
            plain = ""
    parts += [f"'{plain}'"] * bool(plain)
    return "(" + " || ".join(parts or ["''"]) + ")"


def sql_strip(x: str) -> str:
    return f"trim({x}, {sql_string(SPACE_CHARS)})"


def sql_hash64(x: str) -> str:
    return f"('0x' || substr(sha256({x}), 1, 15))::BIGINT"


def sql_grams(width: int, w: str = "w") -> str:
    return f"list_transform(range(1, len({w}) - {width - 2}), lambda i: array_to_string({w}[i:i + {width - 1}], ' '))"


def sql_split_words(x: str) -> str:
    return f"regexp_extract_all({x}, '{NO_SPACE}+')"


def sql_split_lines(x: str) -> str:
    parts = f"string_split_regex({x}, '{LINE_BREAK}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:-2] ELSE {parts} END)"

"""Cleaning, genre labels, names and canonical JSON as column expressions, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, body, split_lines, sql_split_lines, sql_strip, strip

# Markers around a book's own text.
START = r"^\s*\*{3}\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*$"
END = r"^\s*\*{3}\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK"
# Openings of paragraphs that are no story, and the shape of a contents page.
BOILERPLATE = ("Note: Project Gutenberg also has an HTML version", "Produced by ", "Penguin Books Ltd, Harmondsworth")
CONTENTS_PAGE = ("PAGE I.", r"\bII\.\s+.*\bIII\.")
# Genres by words of a title, by terms of metadata, and the terms of control tokens.
TITLE_GENRES = {
    "crime": r"\b(crime|criminal|murder|murderer|thief|robbery)\b",
    "noir": r"\bnoir\b",
    "mystery": r"\b(mystery|mysteries|detective|sleuth|sherlock|clue)\b",
    "horror": r"\b(horror|ghost|haunted|vampire|terror|supernatural)\b",
    "science_fiction": r"\b(science fiction|martian|mars|interplanetary|space voyage|time machine)\b",
    "western": r"\b(western|cowboy|ranch|frontier|prairie)\b",
    "adventure": r"\b(adventure|adventures|pirate|buccaneer|jungle|sea tale)\b",
    "fantasy": r"\b(fantasy|fairy|wizard|magic|magical|enchanted)\b",
    "weird": r"\b(weird|occult|eldritch)\b",
}
BROAD_GENRES = {
    "crime": ("crime", "criminal", "murder", "thieves"),
    "mystery": ("mystery", "detective", "suspense"),
    "horror": ("horror", "ghost", "gothic", "supernatural"),
    "science_fiction": ("science fiction", "interplanetary", "space travel"),
    "western": ("western", "cowboy", "frontier"),
    "adventure": ("adventure", "sea stories", "pirates", "survival"),
    "fantasy": ("fantasy", "fairy tale", "folklore", "magic"),
    "weird": ("weird fiction", "occult", "eldritch"),
}
CONTROL_GENRES = {
    "crime": ("crime", "criminal", "murder"),
    "noir": ("noir",),
    "mystery": ("mystery", "detective", "suspense", "thriller"),
    "horror": ("horror", "gothic", "ghost", "supernatural", "paranormal"),
    "science_fiction": ("science fiction", "sci-fi", "speculative", "dystopian"),
    "western": ("western", "frontier", "cowboy"),
    "adventure": ("adventure", "quest", "survival"),
    "fantasy": ("fantasy", "fairy tale", "magic", "magical", "folklore", "fable"),
    "weird": ("weird", "occult", "eldritch"),
}


# Cleaning -----------------------------------------------------------------------------


def unix_lines(text: Column) -> Column:
    """Line feeds alone, no NUL."""
    out = F.replace(F.replace(body(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.replace(out, F.lit("\x00"), F.lit(""))


def clean_story(text: Column) -> Column:
    return strip(unix_lines(text))


def drop_boilerplate(text: Column) -> Column:
    """Paragraphs (between blank lines) without those that only a transcription or a publisher wrote."""
    paragraphs = F.split(body(text), "\n\n", -1)

    def kept(p):
        flat = strip(F.regexp_replace(p, f"{SPACE}+", " "))
        bad = flat.startswith(CONTENTS_PAGE[0]) & flat.rlike(CONTENTS_PAGE[1])
        for opening in BOILERPLATE:
            bad = bad | flat.startswith(opening)
        return ~bad

    return strip(F.array_join(F.filter(paragraphs, kept), "\n\n"))


def between_markers(text: Column) -> Column:
    """The part after the first start marker's line and before the first end marker."""
    out = F.regexp_replace(unix_lines(text), rf"\A(?s:.*?)(?dim:{START})", "")
    return F.regexp_replace(out, rf"(?dim:{END})(?s:.*)\z", "")


def clean_wrapped(text: Column) -> Column:
    """``between_markers`` without white space at the ends of lines and of the text."""
    lines = F.transform(split_lines(between_markers(text)), lambda x: F.regexp_replace(x, rf"{SPACE}+\z", ""))
    return strip(F.array_join(lines, "\n"))


def clean_book(text: Column) -> Column:
    """``clean_wrapped`` with runs of blank lines made one."""
    lines = F.transform(split_lines(between_markers(text)), lambda x: F.regexp_replace(x, rf"{SPACE}+\z", ""))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n"))


# Genres -------------------------------------------------------------------------------


def title_genres(title: Column) -> Column:
    return F.array_compact(F.array(*(F.when(body(title).rlike(f"(?i){p}"), g) for g, p in TITLE_GENRES.items())))


def _any_term(text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return found


def broad_genres(metadata: Column) -> Column:
    """Genres whose terms occur in an array of metadata strings."""
    joined = F.lower(F.array_join(metadata, " | "))
    return F.array_compact(F.array(*(F.when(_any_term(joined, t), g) for g, t in BROAD_GENRES.items())))


def control_token(genres: Column) -> Column:
    """The first control genre, in declared order, whose terms occur; null if none does."""
    joined, out = F.lower(F.array_join(genres, " | ")), None
    for g, terms in CONTROL_GENRES.items():
        out = F.when(_any_term(joined, terms), f"<|{g}|>") if out is None else out.when(_any_term(joined, terms), f"<|{g}|>")
    return out


# Names --------------------------------------------------------------------------------


def folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalized_name(name: Column) -> Column:
    """Lower case, no years of life at the end, runs of other signs made one space, else unknown."""
    out = F.regexp_replace(folded(body(name)), rf",?{SPACE}*(?:ca?\.{SPACE}*)?\d{{4}}{SPACE}*[-–]{SPACE}*(?:\d{{4}})?{SPACE}*\z", "")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}_]+", " "))
    return F.when(out != "", out).otherwise("unknown")


def creators(value: Column) -> Column:
    """Array of (name, role): parts between semicolons, a role in brackets at a part's end."""
    parts = F.filter(F.transform(F.split(body(value), ";"), strip), lambda x: x != "")
    pattern = rf"{SPACE}*\[([^\]]+)\]{SPACE}*\z"
    role = lambda p: F.when(p.rlike(pattern), folded(strip(F.regexp_extract(p, pattern, 1)))).otherwise("unspecified")
    return F.transform(parts, lambda p: F.struct(strip(F.regexp_replace(p, pattern, "")).alias("name"), role(p).alias("role")))


def primary_creator(found: Column) -> Column:
    """struct(name, role, author): the first of ``creators``; the author only if the role is open or author."""
    first = F.get(found, 0)
    name, role = F.coalesce(first["name"], F.lit("unknown")), F.coalesce(first["role"], F.lit("unknown"))
    return F.struct(name.alias("name"), role.alias("role"), F.when(role.isin("unspecified", "author"), name).alias("author"))


def collection_key(source: Column, source_id: Column, collection: Column) -> Column:
    """A stable id where the source has one, else the collection's normalised title, scoped by source."""
    title = F.trim(F.regexp_replace(folded(F.coalesce(collection, F.lit("unknown"))), r"[^\p{L}\p{N}_]+", " "))
    return F.when((source == "project_gutenberg") & (F.coalesce(source_id, F.lit("")) != ""), F.concat(F.lit("project_gutenberg:"), source_id)).otherwise(
        F.concat_ws(":", F.coalesce(source, F.lit("unknown")), title)
    )


def safely_public(author: Column) -> Column:
    """Blank, or no open span of life and no year after 1955; without a year only if anonymous or unknown."""
    a = body(author)
    years = F.transform(F.regexp_extract_all(a, F.lit(r"(?<!\d)(1[0-9]{3}|20[0-9]{2})(?!\d)"), F.lit(1)), lambda x: x.cast("int"))
    open_ = a.rlike(rf"(?<!\d)(?:1[0-9]{{3}}|20[0-9]{{2}})\??-{SPACE}*(?:;|\z)")
    nameless = F.contains(F.lower(a), F.lit("anonymous")) | F.contains(F.lower(a), F.lit("unknown"))
    return F.when(strip(a) == "", True).when(open_, False).when(F.size(years) == 0, nameless).otherwise(F.array_max(years) <= 1955)


# Canonical JSON -----------------------------------------------------------------------


def json_string(value: Column, ascii_only: bool = True) -> Column:
    """A JSON string; with ``ascii_only`` other signs become escapes, those beyond 16 bits pairs."""
    plain = F.concat(F.lit('"'), value, F.lit('"'))
    short = {"\\": r"\\", '"': r"\"", "\b": r"\b", "\f": r"\f", "\n": r"\n", "\r": r"\r", "\t": r"\t"}

    def escape(c):
        out = None
        for sign, to in short.items():
            out = F.when(c == F.lit(sign), F.lit(to)) if out is None else out.when(c == F.lit(sign), F.lit(to))
        code = F.ascii(c)
        unit = lambda n: F.concat(F.lit(r"\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
        pair = F.concat(unit(F.floor((code - 65536) / 1024).cast("int") + 55296), unit((code - 65536) % 1024 + 56320))
        out = out.when(code < 32, unit(code))
        return (out.when(code > 65535, pair).when(code > 126, unit(code)) if ascii_only else out).otherwise(c)

    odd = value.rlike(r'[^\x20-\x7E]|["\\]' if ascii_only else r'[\x00-\x1f"\\]')
    return F.when(odd, F.concat(F.lit('"'), F.array_join(F.transform(F.split(value, ""), escape), ""), F.lit('"'))).otherwise(plain)


def json_value(value: Column, kind: str, ascii_only: bool = True) -> Column:
    """JSON of a string, a number, a boolean or an array of strings; null is null."""
    if kind == "string":
        out = json_string(value, ascii_only)
    elif kind == "array<string>":
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_string(x, ascii_only)), "," if ascii_only else ", "), F.lit("]"))
    else:
        out = value.cast("string")
    return F.coalesce(out, F.lit("null"))


def canonical_json(fields: dict[str, tuple[Column, str]]) -> Column:
    """Keys sorted, no white space, ASCII: ``fields`` maps a key to (value, kind)."""
    parts = [F.concat(F.lit(f'"{k}":'), json_value(*fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical_list(*values: tuple[Column, str]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *(json_value(*v) for v in values)), F.lit("]"))


def json_line(fields: dict[str, tuple[Column, str]]) -> Column:
    """The other dialect: keys in the order given, a space after each sign, UTF-8, a line feed."""
    parts = [F.concat(F.lit(f'"{k}": '), json_value(*v, ascii_only=False)) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}\n"))


def record_hash(fields: dict[str, tuple[Column, str]]) -> Column:
    return F.sha2(canonical_json(fields).cast("binary"), 256)


def stable_seed(seed: int, *parts: tuple[Column, str]) -> Column:
    """Leading 64 bits of the SHA-256 of the list's canonical JSON, unsigned, as decimal digits."""
    return F.conv(F.substring(F.sha2(canonical_list((F.lit(seed), "int"), *parts).cast("binary"), 256), 1, 16), 16, 10)


def short_id(prefix: str, length: int, *parts: tuple[Column, str]) -> Column:
    """A prefix and the first hex digits of the SHA-256 of the list's canonical JSON."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical_list(*parts).cast("binary"), 256), 1, length))


# SQL twins ----------------------------------------------------------------------------


def sql_unix(x: str) -> str:
    return f"replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), '')"


def sql_between(x: str) -> str:
    return rf"regexp_replace(regexp_replace({sql_unix(x)}, '\A(?s:.*?)(?im:{START})', ''), '(?im:{END})(?s:.*)\z', '')"


def sql_rstripped(x: str) -> str:
    return rf"array_to_string(list_transform({sql_split_lines(sql_between(x))}, lambda l: regexp_replace(l, '{SPACE}+\z', '')), chr(10))"


def sql_drop_boilerplate(x: str) -> str:
    flat = sql_strip(f"regexp_replace(p, '{SPACE}+', ' ', 'g')")
    bad = " OR ".join([f"starts_with({flat}, '{o}')" for o in BOILERPLATE] + [f"(starts_with({flat}, '{CONTENTS_PAGE[0]}') AND regexp_matches({flat}, '{CONTENTS_PAGE[1]}'))"])
    return sql_strip(f"array_to_string(list_filter(string_split({x}, chr(10) || chr(10)), lambda p: NOT ({bad})), chr(10) || chr(10))")


def sql_title_genres(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, '(?i){p}') THEN '{g}' END" for g, p in TITLE_GENRES.items()) + "], lambda g: g IS NOT NULL)"


def _sql_any(x: str, terms: tuple[str, ...]) -> str:
    return " OR ".join(f"contains({x}, '{t}')" for t in terms)


def sql_broad_genres(joined: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_sql_any(joined, t)} THEN '{g}' END" for g, t in BROAD_GENRES.items()) + "], lambda g: g IS NOT NULL)"


def sql_control_token(joined: str) -> str:
    return "CASE " + " ".join(f"WHEN {_sql_any(joined, t)} THEN '<|{g}|>'" for g, t in CONTROL_GENRES.items()) + " END"


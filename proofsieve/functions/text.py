"""Column functions on text: cleaning, sections, tokens, sentences, citations, identifiers.

White space is written out as ``[ \\t\\r\\n\\f]`` so that it means the same in every engine.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofsieve.functions.terms import ALIASES, CLAIM_HINTS, SECTIONS, STOP_WORDS

SPACE = r"[ \t\r\n\f]"
#: Also what counts as white space beyond ASCII.
ANY_SPACE = r"[ \t\r\n\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Names of characters, with their semicolon, and those that may go without one, the longest first.
NAMED = {k: v for k, v in html5.items() if k.endswith(";")}
SHORT = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
#: Numbers from 128 to 159 mean what they mean in Windows-1252, where that has a character.
WINDOWS = {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160)}
#: Headings of the sections that are looked for, with the code that marks them.
MARKERS = [("business", r"Item\s*1[.\s]+Business"), ("risk_factors", r"Item\s*1A[.\s]+Risk\s*Factors"), ("md&a", r"Item\s*7[.\s]+Management"), ("market_risk", r"Item\s*7A[.\s]+Quantitative")]
#: Stands before a marked heading; texts lose it first.
MARK = "\x01"
WORD, NUMBER, CITATION = r"[A-Za-z0-9][A-Za-z0-9&'\-/]*", r"\$?[0-9][0-9,]*(?:\.[0-9]+)?%?", r"\[([0-9]+)\]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(x: Column | str) -> Column:
    """Without white space at the ends."""
    return F.btrim(col(x), F.lit(" \t\r\n\f"))


def given(x: Column | str) -> Column:
    """Null if blank."""
    return F.when(stripped(x) != "", col(x))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def runs(ordered: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Array of f(value, how often it is there) of each distinct value of an ordered array without nulls, in one pass. ``ordered`` should be a column or come through ``once``."""
    n = F.size(ordered)
    at = F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i)), lambda i: i.isNotNull())
    return once(at, lambda first: F.transform(first, lambda p, k: f(F.get(ordered, p), F.coalesce(F.get(first, k + 1), n) - p)))


def counted(ordered: Column) -> Column:
    """Map of each distinct value of an ordered array without nulls to how often it is there."""
    return F.map_from_entries(runs(ordered, lambda value, n: F.struct(value.alias("value"), n.alias("n"))))


def _looked_up(table: dict[str, str], key: Column) -> Column:
    """The value of a key, or null; by the key's first letter first, so that no list is long."""
    letters = sorted({k[0] for k in table})
    maps = [F.create_map(*[F.lit(x) for k, v in table.items() if k[0] == letter for x in (k, v)]) for letter in letters]
    return F.try_element_at(F.try_element_at(F.create_map(*[x for pair in zip(map(F.lit, letters), maps, strict=True) for x in pair]), F.substring(key, 1, 1)), key)


def character(number: Column) -> Column:
    """The character of a numeric reference: U+FFFD if there is none, nothing for a control or a non-character."""
    n = F.when(F.length(F.ltrim(F.lit("0"), number)) > 7, F.lit(0)).otherwise(F.coalesce(F.nullif(number, F.lit("")), F.lit("0")).cast("bigint"))
    none = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    silent = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    windows = F.try_element_at(F.create_map(*[x for k, v in WINDOWS.items() for x in (F.lit(k), F.lit(v))]), n.cast("int"))
    made = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(none, "\ufffd").when(n.between(128, 159), windows).when(silent, "").otherwise(made)


def unescaped(text: Column | str) -> Column:
    """Named and numeric character references to characters, each once; what is none stays."""

    def piece(p: Column) -> Column:  # what follows an ampersand
        head = F.substring(p, 1, 40)  # no name is as long
        decimal, hexed, name = F.regexp_extract(p, "^#([0-9]+);?", 1), F.regexp_extract(p, "^#[xX]([0-9a-fA-F]+);?", 1), F.regexp_extract(head, "^[A-Za-z][A-Za-z0-9]*;", 0)
        short = F.regexp_extract(head, f"^({'|'.join(SHORT)})", 1)
        rest = lambda pattern: F.regexp_replace(p, pattern, "")
        long = _looked_up(NAMED, name)
        number = F.when(F.length(F.ltrim(F.lit("0"), hexed)) > 7, "99999999").otherwise(F.conv(hexed, 16, 10))
        return (
            F.when(F.startswith(p, F.lit("amp;")), F.concat(F.lit("&"), F.substring(p, 5, F.length(p))))  # by far the commonest
            .when(decimal != "", F.concat(character(F.when(F.length(F.ltrim(F.lit("0"), decimal)) > 7, "9999999").otherwise(decimal)), rest("^#[0-9]+;?")))
            .when(hexed != "", F.concat(character(F.when(number == "99999999", "9999999").otherwise(number)), rest("^#[xX][0-9a-fA-F]+;?")))
            .when(long.isNotNull(), F.concat(long, F.substring(p, F.length(name) + 1, F.length(p))))
            .when(short != "", F.concat(_looked_up({k: html5[k] for k in SHORT}, short), F.substring(p, F.length(short) + 1, F.length(p))))
            .otherwise(F.concat(F.lit("&"), p))
        )

    def whole(t: Column) -> Column:
        parts = once(F.split(t, "&"), lambda x: F.concat(x[0], F.array_join(F.transform(F.slice(x, 2, F.size(x)), piece), "")))
        return F.when(F.contains(t, F.lit("&")), parts).otherwise(t)

    return once(col(text), whole)


def html_to_text(html: Column | str) -> Column:
    """Tags to spaces, character references to characters, white space to single spaces."""
    spaced = F.regexp_replace(unescaped(F.regexp_replace(col(html), "<[^>]+>", " ")), f"{ANY_SPACE}+", " ")
    return F.trim(spaced)


def marked_sections(text: Column | str) -> Column:
    """The text with MARK before each heading, all headings in one pass."""
    either = "|".join(f"(?:{pattern})" for _, pattern in MARKERS)
    return F.regexp_replace(F.replace(col(text), F.lit(MARK), F.lit("")), f"(?i)({either})", f"{MARK}$1")


def section_pieces(text: Column | str) -> Column:
    """Array of (name, content) from each heading to the next, in the order of the text. The text is cut once, however many pieces it has."""

    def named(piece: Column) -> Column:
        name = F.lit(None).cast("string")
        for key, pattern in reversed(MARKERS):
            name = F.when(piece.rlike(f"(?i)^(?:{pattern})"), key).otherwise(name)
        return F.struct(name.alias("name"), piece.alias("content"))

    # Before the first heading stands part 0.
    return once(F.split(marked_sections(text), MARK), lambda parts: F.when(F.size(parts) > 1, F.transform(F.slice(parts, 2, F.size(parts)), named)))


def clean_section_text(text: Column | str) -> Column:
    """CRLF to LF, three or more LF to two, runs of spaces and tabs to one space, trimmed."""
    out = F.replace(col(text), F.lit("\r\n"), F.lit("\n"))
    return stripped(F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), "[ \t]+", " "))


def normalize_token(text: Column | str) -> Column:
    """Lower case, & as a word, apostrophes dropped, anything but letters and digits to single spaces."""
    out = F.replace(F.lower(stripped(text)), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "['’]", ""), "[^a-z0-9]+", " "))


def normalize_python(text: str) -> str:
    """``normalize_token`` for a constant."""
    import re

    out = re.sub("['’]", "", text.strip().lower().replace("&", " and "))
    return re.sub("[^a-z0-9]+", " ", out).strip()


def canonical_section_key(name: Column | str) -> Column:
    """The first section one of whose aliases is the normalized name or the start of it, else null."""

    def first(n: Column) -> Column:
        out = F.lit(None).cast("string")
        for key, aliases in reversed(ALIASES.items()):
            hit = F.lit(False)
            for alias in map(normalize_python, aliases):
                hit = hit | (n == alias) | F.startswith(n, F.lit(f"{alias} "))
            out = F.when(hit, key).otherwise(out)
        return out

    return once(normalize_token(name), first)


def section_slug(name: Column | str) -> Column:
    """Slug of a name that is no known section."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(stripped(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.when(slug != "", slug), F.lit("unknown_section"))


def section_descriptor(name: Column | str) -> Column:
    """(key, display_name, slug) of a section name, canonical where it is known."""
    key, known = canonical_section_key(name), F.create_map(*[F.lit(x) for k, (d, s) in SECTIONS.items() for x in (k, f"{d}|{s}")])
    found = F.split(known[key], r"\|")
    return F.struct(F.coalesce(key, section_slug(name)).alias("key"), F.coalesce(found[0], given(F.trim(stripped(name))), F.lit("Unknown Section")).alias("display_name"), F.coalesce(found[1], section_slug(name)).alias("slug"))


def tokens(text: Column | str) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9]+"), F.lit(0))


def space_tokens(text: Column | str) -> Column:
    """White-space words, case kept."""
    return F.filter(F.split(col(text), f"{SPACE}+"), lambda x: x != "")


def sentences(text: Column | str) -> Column:
    """Pieces between white space after . ! ? and line ends, trimmed, blanks dropped."""
    cut = F.regexp_replace(F.regexp_replace(col(text), f"([.!?]){SPACE}+", f"$1{MARK}"), "\n+", MARK)
    return F.filter(F.transform(F.split(cut, MARK), stripped), lambda x: x != "")


def content_tokens(text: Column | str) -> Column:
    """Words in lower case, less stop words and single characters; repeats kept."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.transform(F.regexp_extract_all(col(text), F.lit(WORD), F.lit(0)), F.lower)
    return F.filter(words, lambda x: ~F.array_contains(stop, x) & (F.length(x) > 1))


def numbers(text: Column | str) -> Column:
    """Distinct numbers with $ and %, without commas."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def is_claim(sentence: Column | str) -> Column:
    """No heading, three content words, and a number or a hint word."""
    words, hints = content_tokens(sentence), F.array(*[F.lit(w) for w in CLAIM_HINTS])
    return ~F.startswith(stripped(sentence), F.lit("#")) & (F.size(words) >= 3) & ((F.size(numbers(sentence)) > 0) | F.arrays_overlap(words, hints))


def citations(text: Column | str) -> Column:
    """All cited numbers in order, repeats kept."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))


def strip_citations(text: Column | str) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(col(text), CITATION, ""), f"{SPACE}+", " "))


def eval_normalize(text: Column | str) -> Column:
    """Trimmed, lower case, & as 'and' without spaces; punctuation kept."""
    return F.replace(F.lower(stripped(text)), F.lit("&"), F.lit("and"))


def filing_url(base: str, cik: Column | str, accession: Column | str, document: Column | str) -> Column:
    return F.concat_ws("/", F.lit(base), col(cik), F.replace(col(accession), F.lit("-"), F.lit("")), col(document))


def source_name(url: Column | str) -> Column:
    """First label of the host without www., with a capital; 'Unknown' if there is no host."""
    host = F.regexp_replace(F.try_parse_url(col(url), F.lit("HOST")), r"^www\.", "")
    return F.coalesce(given(F.initcap(F.split_part(host, F.lit("."), F.lit(1)))), F.lit("Unknown"))


def point_id(id_: Column | str) -> Column:
    """The id if it is a UUID, else its UUID version 5 in the URL namespace."""
    text = col(id_)
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(text, "utf-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    made = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(F.lit("89ab").substr(nibble + 1, F.lit(1)), F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
    return F.when(F.lower(text).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lower(text)).otherwise(made)


def default_query_text(query: Column | str, ticker: Column | str, filing_type: Column | str, section: Column | str) -> Column:
    """The question, or what describes the scope, or 'SEC filing'."""
    return F.coalesce(given(query), given(F.concat_ws(" ", given(ticker), given(filing_type), given(section))), F.lit("SEC filing"))


def format_market_cap(value: Column | str) -> Column:
    """$ with T, B or M and two decimals; null for 0 and null."""
    v = col(value).cast("double")
    scaled = lambda unit, letter: F.format_string(f"$%.2f{letter}", v / unit)
    return F.when(v >= 1e12, scaled(1e12, "T")).when(v >= 1e9, scaled(1e9, "B")).when(v != 0, scaled(1e6, "M"))

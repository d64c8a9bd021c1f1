"""Column expressions on single texts: keys, hashes, lengths and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.fixed_values import MAX_TOKEN_CHARS, UUID_NAMESPACE_OID

SPACE = r" \t\n\r\f"
WORD_CHAR = r"\p{L}\p{N}_"
ANY_SPACE = r"\x09-\x0D\x1C-\x20\x85\p{Z}"
# Line ends besides the line feed: carriage return, vertical tab, form feed, separators, next line.
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
PIECE = rf"[^{SPACE}]+"
# A word run is taken whole (no backtracking), so what the second part meets is never a word character.
WORD_OR_MARK = rf"[{WORD_CHAR}]++|[^{SPACE}]"
# Scripts that are written without spaces between words, or in syllable blocks; the next pattern finds one character of them.
UNSPACED = ("Han", "Hiragana", "Katakana", "Hangul", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")
UNSPACED_CHAR = "([" + "".join(rf"\p{{Is{s}}}" for s in UNSPACED) + "])"
TOKENIZERS = ("word", "word_or_mark", "char", "byte")


def hash32(text: Column) -> Column:
    """First 32 bits of md5 as a long: the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bucket(text: Column, n: int) -> Column:
    return hash32(text) % F.lit(n)


def seeded(seed: int | str, key: Column) -> Column:
    """Text to hash for a repeatable shuffle or draw."""
    return F.concat(F.lit(f"{seed}|"), key.cast("string"))


def uuid5(text: Column, namespace: str = UUID_NAMESPACE_OID) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(text, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def text_key(text: Column) -> Column:
    """32 bytes that stand for a text in joins and groups, so that the text itself is not shuffled or compared. SHA-256:
    two texts with one key are not known and not looked for. A null text has no key."""
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def chars(text: Column) -> Column:
    return F.length(text).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def latin_share(text: Column) -> Column:
    """Characters per byte: 1 for plain ASCII, less with other scripts; null for empty text."""
    return F.length(text) / F.nullif(F.octet_length(text), F.lit(0))


def is_blank(text: Column) -> Column:
    """True for null, empty or white-space text."""
    return ~F.coalesce(text.rlike(rf"[^{ANY_SPACE}]"), F.lit(False))


def strip(text: Column) -> Column:
    """Trim white space of any script on both sides."""
    return F.regexp_replace(text, rf"^[{ANY_SPACE}]+|[{ANY_SPACE}]+$", "")


def line_count(text: Column) -> Column:
    """Number of lines; a line end at the very end opens no new line."""
    plain = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), LINE_ENDS, "\n" * len(LINE_ENDS))
    ends = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))
    open_line = (plain != "") & ~F.endswith(plain, F.lit("\n"))
    return ends + open_line.cast("int")


def tokens(text: Column, kind: str) -> Column:
    """Token texts of a native tokenizer.

    ``vocab_word`` gives words and marks of at most MAX_TOKEN_CHARS: a longer word is cut there, and each character of a script
    without spaces is a token, so no text is out of a word vocabulary's reach as a whole.
    """
    if kind == "word":
        return F.regexp_extract_all(text, F.lit(PIECE), 0)
    if kind == "word_or_mark":
        return F.regexp_extract_all(text, F.lit(WORD_OR_MARK), 0)
    if kind == "vocab_word":  # what a vocabulary of whole words can hold
        apart = F.regexp_replace(text, UNSPACED_CHAR, " $1 ")
        return F.regexp_extract_all(apart, F.lit(rf"[{WORD_CHAR}]{{1,{MAX_TOKEN_CHARS}}}|[^{SPACE}]"), 0)
    if kind == "char":
        return F.regexp_extract_all(text, F.lit(r"(?s)."), 0)
    if kind == "byte":
        return F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(r".."), 0)
    raise ValueError(f"unknown tokenizer {kind!r}; one of {TOKENIZERS}")


def token_count(text: Column, kind: str) -> Column:
    """Number of tokens, without building the token list."""
    if kind == "word":
        return F.regexp_count(text, F.lit(PIECE)).cast("long")
    if kind == "word_or_mark":
        return F.regexp_count(text, F.lit(WORD_OR_MARK)).cast("long")
    if kind == "char":
        return chars(text)
    if kind == "byte":
        return utf8_bytes(text)
    raise ValueError(f"unknown tokenizer {kind!r}; one of {TOKENIZERS}")


def fixed_point(value: Column, places: int = 4) -> Column:
    """Decimal text with a fixed number of places, rounded half up."""
    scale = 10**places
    units = F.floor(F.abs(value) * scale + 0.5).cast("long")
    sign = F.when((value < 0) & (units > 0), "-").otherwise("")
    whole = F.floor(units / F.lit(scale)).cast("long").cast("string")
    return F.concat(sign, whole, F.lit("."), F.lpad((units % scale).cast("string"), places, "0"))

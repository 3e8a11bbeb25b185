"""Normalisation, folding, tokens and word predicates, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of words that lexicons take; one apostrophe may stand between two of them.
LETTERS = "a-zþðæöáéíóúý"
WORD = rf"^[{LETTERS}]+('[{LETTERS}]+)*$"
_ACCENTED, _BASE = "áéíóúýö", "aeiouyo"
_WIDE, _WIDE_BASE = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """NFC; texts of ASCII only never leave the JVM's side of the condition."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_nfc(text))


def straight(text: Column) -> Column:
    """Typographic apostrophes as straight ones."""
    return F.translate(text, "’‘", "''")


def normal_word(word: Column) -> Column:
    return nfc(F.lower(straight(word)))


def strip_accents(word: Column) -> Column:
    """Accents of vowels go; þ, ð and æ are letters of their own and stay."""
    return F.translate(word, _ACCENTED, _BASE)


def strip_all_accents(word: Column) -> Column:
    """The same for Latin letters of western languages."""
    return F.translate(word, _WIDE, _WIDE_BASE)


def skeleton(word: Column) -> Column:
    """What a hurried hand types: no acute, ð as d, þ as t; ö stays."""
    return F.translate(word, "áéíóúýðþ", "aeiouydt")


def category_base(word: Column) -> Column:
    """The base for telling accent-only changes: also ö as o and æ as a."""
    return F.translate(word, "áéíóúýöæðþ", "aeiouyoadt")


def is_word(word: Column) -> Column:
    return word.rlike(WORD)


def is_icelandic(text: Column) -> Column:
    return text.rlike("[þðæöáéíóúýÞÐÆÖÁÉÍÓÚÝ]")


def is_importable(word: Column) -> Column:
    """Two letters at least, letters at both ends, apostrophes and hyphens between."""
    return word.rlike(r"^\p{L}[\p{L}'\-]*\p{L}$")


def is_learnable(word: Column) -> Column:
    """1 to 64 signs, no white space, control sign or pictograph, one letter at least."""
    return (F.length(word) >= 1) & (F.length(word) <= 64) & word.rlike(r"\p{L}") & ~word.rlike(r"[\s\p{Cc}\p{So}]")


def is_eligible(token: Column) -> Column:
    """A token that an analysis of misses looks at."""
    return (F.length(token) >= 2) & ~token.rlike(r"^(#|@|http)") & ~token.rlike(r"[0-9]") & token.rlike(r"\p{L}")


def is_verbatim(token: Column) -> Column:
    """An address, a handle or a file name: a dot or @ inside, or a first sign that begins no word."""
    return token.rlike(r"^.+[.@].+$") | token.rlike(r"^[^\p{L}\p{N}]")


TLDS = ("com", "org", "net", "is", "io", "dev", "edu", "gov", "info", "app")


def is_url_like(token: Column) -> Column:
    return F.lower(F.element_at(F.split(token, r"\."), -1)).isin(*TLDS) & token.contains(".")


def words(text: Column) -> Column:
    """Lower-case runs of letters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def spaced(text: Column) -> Column:
    """Tokens between white space, in order; a newline is a space."""
    return F.filter(F.split(F.translate(text, "\n\t\r", "   "), " +"), lambda x: x != "")


def clean_token(token: Column) -> Column:
    return F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


BAD_PARTS = ("|", "http", "www", "{", "}", "[", "]", "<", ">", "=")


def is_clean_sentence(s: Column, least: int = 30, most: int = 240, words_least: int = 5, digits: float = 0.2) -> Column:
    bad = F.lit(False)
    for part in BAD_PARTS:
        bad = bad | s.contains(part)
    return F.length(s).between(least, most) & (F.size(F.split(s, " +")) >= words_least) & s.rlike(r"[.!?]$") & s.rlike(r"^\p{Lu}") & ~bad & (F.regexp_count(s, F.lit("[0-9]")) <= digits * F.length(s))


def is_structural(line: Column) -> Column:
    """Headings and list items."""
    return line.rlike(r"^\s*(=+.*=+|#+\s.*|[*\-•].*|[0-9]+[.)].*)\s*$")


def is_title(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}\p{Ll}+$")


def patronymic(word: Column) -> Column:
    """Capital for names of the sson and dóttir kind."""
    return F.when(word.rlike("(sson|dóttir)$") & (F.length(word) > 6), F.initcap(word)).otherwise(word)


def case_variants(word: Column) -> Column:
    return F.array_distinct(F.array(word, F.lower(word), F.initcap(F.lower(word))))


def escape_tsv(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


@F.pandas_udf(T.StringType())
def unescape_tsv(text: pd.Series) -> pd.Series:
    """One pass from the left, so that an escaped backslash never begins another escape."""
    import re

    kinds = {"t": "\t", "n": "\n", "r": "\r"}
    return text.map(lambda t: re.sub(r"\\(.)", lambda m: kinds.get(m[1], m[1]), t, flags=re.S), na_action="ignore")


def sentences(text: Column) -> Column:
    """Cut after . ! ? before white space and a capital; common abbreviations and single letters don't end one."""
    held = F.regexp_replace(text, r"(?i)\b(t\.d|o\.s\.frv|m\.a|dr|mr|mrs|ms|st|vs|etc|e\.g|i\.e|no|kr|nr|bls|[a-z])\.\s", "$1.\u0001")
    return F.transform(F.split(held, r"(?<=[.!?])\s+(?=\p{Lu})"), lambda s: F.translate(F.trim(s), "\u0001", " "))


def smart_quote(before: Column) -> Column:
    """The quotation mark to put after a text: an opener where a word may begin, a closer only if an opener waits."""
    opens = F.regexp_count(before, F.lit("„")) - F.regexp_count(before, F.lit("“"))
    return F.when((before == "") | before.rlike(r"[\s(\[{]$"), F.lit("„")).when(opens > 0, F.lit("“")).otherwise(F.lit('"'))


def token_field(tokens: Column) -> Column:
    return F.concat(F.lit("|"), F.concat_ws("|", tokens), F.lit("|"))


def parse_token_field(field: Column) -> Column:
    return F.filter(F.split(field, r"\|"), lambda x: x != "")

"""Column functions for text: each takes and returns columns, all on built-in expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quernel.functions import fixed

_CP1251_HIGH = bytes(b for b in range(0x80, 0x100) if b != 0x98)


def strip(c: Column) -> Column:
    """Without white space at both ends, of whatever kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fill(template: str, *columns: Column) -> Column:
    """``template`` with its ``%s`` filled in order; null if any of them is."""
    texts = template.split("%s")
    return F.concat(F.lit(texts[0]), *(x for c, t in zip(columns, texts[1:]) for x in (c, F.lit(t))))


def matches(c: Column, pattern: str) -> Column:
    """Whether a pattern occurs, ignoring case in every script; false for null."""
    return F.coalesce(c.rlike(f"(?iU){pattern}"), F.lit(False))


def tokenize(c: Column) -> Column:
    """Lower-cased runs of Latin and Cyrillic letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-zа-яё0-9]+"), F.lit(0))


def significant_words(c: Column, stop_words=fixed.COUNT_STOP_WORDS, min_len: int = 4) -> Column:
    """Lower-cased words of at least ``min_len`` letters that are no stop words, repeats kept."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\W+")
    return F.filter(parts, lambda w: (F.length(w) >= min_len) & (~w.isin(*stop_words) if stop_words else F.lit(True)))


def stems(words: Column, n: int = 5) -> Column:
    """Distinct beginnings of ``n`` characters."""
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, n)))


def stems_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def ordered_distinct(a: Column) -> Column:
    """Distinct elements in the order in which they first occur."""
    return F.array_distinct(a)


def normalize_article(c: Column) -> Column:
    """Key of an article number: look-alike Latin letters become Cyrillic, only letters and digits stay."""
    return F.regexp_replace(F.translate(F.lower(c), fixed.LATIN, fixed.CYRILLIC), "[^0-9a-zа-я]", "")


def is_article_key(key: Column) -> Column:
    """Long enough, and neither all digits nor all letters."""
    return (F.length(key) >= fixed.MIN_ARTICLE) & ~key.rlike("^[0-9]+$") & ~key.rlike("^[a-zа-я]+$")


def article_candidates(c: Column, pattern: str = "(?U)" + fixed.ARTICLE) -> Column:
    """Spellings in a text that may be article numbers."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0)), strip)
    return F.filter(found, lambda raw: is_article_key(normalize_article(raw)))


def to_number(c: Column) -> Column:
    """A number with comma or dot; anything else, underscores included, is 0."""
    plain = strip(F.replace(c, F.lit(","), F.lit(".")))
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def to_year(c: Column) -> Column:
    """The first year of 1900 to 2099 that stands as a word of its own, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?U)\b(?:19|20)\d{2}\b", 0), F.lit("")).try_cast("int")


def asked_year(c: Column, as_of_year: int) -> Column:
    return F.coalesce(to_year(c), F.lit(as_of_year))


def format_number(c: Column) -> Column:
    """Without decimals if integral, else with one, rounded from the exact binary value, ties to even."""
    whole = c == F.floor(c)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(_one_decimal(F.when(~whole, c)))


@F.pandas_udf(StringType())
def _one_decimal(values: pd.Series) -> pd.Series:
    """Built-in functions round the shortest decimal form instead: 0.35 would give 0.4."""
    return pd.Series([None if v != v else f"{v:.1f}" for v in values.to_numpy(float, na_value=float("nan"))], dtype=object)


def replacement_words(words: Column) -> Column:
    """Words of a replacement question that name equipment."""
    return F.filter(words, lambda w: ~w.rlike(f"(?iU)^(?:{fixed.FACT_REPLACEMENT})$") & ~w.rlike(f"(?U)^(?:{fixed.YEAR_WORD})$"))


def document_title(file_name: Column) -> Column:
    """File stem without a leading file number; underscores become spaces."""
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")
    return strip(F.replace(F.regexp_replace(stem, r"(?U)^Файл\s*\d+\s*-\s*", ""), F.lit("_"), F.lit(" ")))


def safe_filename(c: Column) -> Column:
    """Last path component with unusual characters replaced; ``upload`` if nothing is left."""
    last = F.element_at(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "/+$", ""), "/"), -1)
    last = F.when(last.isin(".", ".."), "").otherwise(last)
    clean = strip(F.regexp_replace(last, r"(?U)[^\w\s.()\[\]-]", "_"))
    return F.when(clean == "", "upload").otherwise(clean)


def suffix(file_name: Column) -> Column:
    return F.lower(F.regexp_extract(file_name, r"(?<=.)(\.[^./]+)$", 1))


def passage_text(title: Column, heading: Column, text: Column) -> Column:
    """What is embedded for a chunk."""
    path = F.when(F.coalesce(heading, F.lit("")) == "", title).otherwise(F.concat(title, F.lit(" › "), heading))
    return F.concat(F.lit("passage: "), path, F.lit("\n"), text)


def query_text(question: Column) -> Column:
    return F.concat(F.lit("query: "), question)


def searchable(title: Column, heading: Column, text: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(heading, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))


def snippet(c: Column, n: int = 200) -> Column:
    """White space collapsed, cut to ``n`` characters."""
    return F.substring(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), 1, n)


def file_stem(label: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(label, "/"), -1), r"(?<=.)\.[^.]*$", "")


def relevance_percent(distance: Column) -> Column:
    """75 without a distance, else how far it is below one half, in percent."""
    value = F.bround((F.lit(1.0) - distance / 0.5) * 100).cast("int")
    return F.when(distance.isNull(), 75).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), value)))


def relevance_band(percent: Column) -> Column:
    return F.when(percent >= 70, "high").when(percent >= 55, "mid").otherwise("low")


def is_refusal(c: Column, pattern: str = fixed.REFUSAL) -> Column:
    return matches(c, pattern)


def is_procedural(c: Column, pattern: str = fixed.PROCEDURAL_QUESTION) -> Column:
    return matches(c, pattern)


def procedural_markers(c: Column, pattern: str = fixed.PROCEDURAL_TEXT) -> Column:
    """How often a text speaks of procedures."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"(?iU){pattern}"))


def parent_ref(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 16)


def decode_uni_glyphs(c: Column) -> Column:
    """``/uni0421`` becomes its character; surrogate codes stay as they are."""
    parts = F.split(c, r"(?=/uni(?![dD][89a-fA-F])[0-9A-Fa-f]{4})")

    def one(p: Column) -> Column:
        glyph = F.decode(F.unhex(F.substring(p, 5, 4)), "UTF-16BE")
        return F.when(p.rlike(r"^/uni(?![dD][89a-fA-F])[0-9A-Fa-f]{4}"), F.concat(glyph, F.substring(p, 9, 2**31 - 1))).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def repair_text(c: Column) -> Column:
    """Glyph names decoded; Cyrillic that was read as Latin-1 put right if that gains Cyrillic letters."""
    text = decode_uni_glyphs(c)
    latin, cyrillic = F.regexp_count(text, F.lit("[À-ÿ]")), F.regexp_count(text, F.lit("[А-яЁё]"))
    narrow = F.regexp_replace(text, "[^\\x{00}-\\x{97}\\x{99}-\\x{FF}]", "")
    repaired = F.translate(narrow, _CP1251_HIGH.decode("latin-1"), _CP1251_HIGH.decode("cp1251"))
    gains = F.regexp_count(repaired, F.lit("[А-яЁё]")) > cyrillic
    return F.when((latin > 20) & (latin > cyrillic) & gains, repaired).otherwise(text)


def strip_toc_lines(c: Column) -> Column:
    """Without lines of a table of contents: text, dots, page number."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(r"(?U)^\s*\S.*?\.{4,}\s*\d+\s*$")), "\n")


def cosine_distance(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def rows_of(c: Column) -> Column:
    """Blocks between blank lines, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda x: x != "")

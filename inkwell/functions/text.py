"""Column functions on texts; all are built from native functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[a-zA-Z]+(?:'[a-zA-Z]+)?"
#: Words whose syllables the vowel rule miscounts (fixed values).
SYLLABLES = {"simile": 3, "forever": 3, "shoreline": 2, "define": 2, "everything": 4, "another": 3, "higher": 2, "business": 3, "area": 3, "idea": 3, "real": 1, "create": 2, "science": 2}


def words(text: Column) -> Column:
    """The words of a text in order, as written."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lower_words(text: Column) -> Column:
    return F.transform(words(text), F.lower)


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent e, plus a syllabic -le; at least one for any word with letters."""
    bare = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(bare, F.lit("[aeiouy]+"))
    silent = F.when(F.endswith(bare, F.lit("e")) & (groups > 1), 1).otherwise(0)
    syllabic = F.when(F.regexp_like(bare, F.lit("[^aeiouy]le$")), 1).otherwise(0)
    known = F.create_map(*[F.lit(x) for pair in SYLLABLES.items() for x in pair])
    return F.when(bare == "", 0).otherwise(F.coalesce(known[F.lower(word)], F.greatest(groups - silent + syllabic, F.lit(1))))


def share(part: Column, whole: Column, times: float = 1.0) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole, F.lit(0)) * F.lit(times))


def fingerprint(text: Column, chars: int = 16) -> Column:
    """The first characters of the MD5 of the trimmed, lower-cased text with single spaces."""
    return F.substring(F.md5(F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " "))), 1, chars)


def issue_id(paragraph: Column, category: Column, severity: Column, message: Column, flagged: Column) -> Column:
    """A stable id of an issue from where it is and what it says."""
    parts = F.concat_ws("|", paragraph.cast("string"), category, severity, F.substring(message, 1, 100), F.substring(flagged, 1, 50))
    return F.concat(F.lit("ISS-"), F.substring(F.md5(parts), 1, 12))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays; 0 where both are empty."""
    return share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def cosine(a: Column, b: Column) -> Column:
    """Of two equally long number arrays; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def context(text: Column, start: Column, length: Column, width: int = 40) -> Column:
    """The text around a hit: `width` characters on both sides; start counts from 1."""
    first = F.greatest(start - width, F.lit(1))
    return F.substring(text, first, start + length + width - first)


#: Words that say nothing in a line item's description (fixed values).
NOISE_WORDS = ("the", "a", "an", "of", "for", "and", "or", "in", "to", "with", "per")
#: Upper bounds and labels of amounts and counts whose exact value is private (fixed values).
AMOUNT_LABELS = ((100, "$1-$99"), (1_000, "$100-$999"), (10_000, "$1K-$9.9K"), (100_000, "$10K-$99K"), (1_000_000, "$100K-$999K"), (10_000_000, "$1M-$9.9M"), (100_000_000, "$10M-$99M"))
COUNT_LABELS = ((10, "1-9"), (100, "10-99"), (1_000, "100-999"))


def normalized_description(text: Column) -> Column:
    """Lower case without noise words, doubled spaces and a trailing number."""
    bare = F.regexp_replace(F.trim(F.lower(text)), r"\b(" + "|".join(NOISE_WORDS) + r")\b", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"\s*#?\d+\s*$", "")


def _labelled(value: Column, zero: str, labels: tuple[tuple[int, str], ...], most: str) -> Column:
    out = F.when(value.isNull(), "none").when(value == 0, zero)
    for bound, label in labels:
        out = out.when(F.abs(value) < bound, label)
    return out.otherwise(most)


def amount_bucket(amount: Column) -> Column:
    """The magnitude of an amount without the amount."""
    return _labelled(amount, "$0", AMOUNT_LABELS, "$100M+")


def count_bucket(n: Column) -> Column:
    return _labelled(n, "0", COUNT_LABELS, "1000+")

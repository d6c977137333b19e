"""Text columns: normalisers, slugs, titles, word sets and markup removal.

The normalisers look alike and are not the same: each serves one key. None of them may be exchanged for another.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ARTICLES = r"\b(a|an|the)\b"
COMPANY_WORDS = r"\b(ltd|limited|plc)\b"
#: Words that carry no meaning in a title.
STOP_WORDS = ("a", "an", "and", "at", "for", "in", "of", "on", "the", "to", "with")
#: The entities that feeds use.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&pound;", "£"), ("&amp;", "&"))
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"


def norm_text(value: Column) -> Column:
    """Lower case, '&' as 'and', anything but a-z and 0-9 as one space, trimmed; null is empty."""
    lowered = F.replace(F.lower(F.coalesce(value, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(lowered, r"[^a-z0-9]+", " "))


def norm_title(value: Column) -> Column:
    """norm_text without articles."""
    return F.trim(F.regexp_replace(F.regexp_replace(norm_text(value), ARTICLES, " "), " +", " "))


def norm_name(value: Column) -> Column:
    """norm_title without company words."""
    return F.trim(F.regexp_replace(F.regexp_replace(norm_title(value), COMPANY_WORDS, " "), " +", " "))


def collapse_spaces(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))


def title_key(value: Column) -> Column:
    """Headline without its last ' - Publisher', letters and digits only."""
    headline = F.regexp_replace(F.coalesce(value, F.lit("")), r" - [^-]*$", "")
    return F.regexp_replace(F.lower(headline), r"[^a-z0-9]+", "")


def norm_terms(value: Column) -> Column:
    """Apostrophes removed, other punctuation as spaces, lower case: text that term patterns are matched in."""
    plain = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"['’]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9&+ ]", " "), " +", " "))


def words_pattern(phrases: tuple[str, ...], space: str = r"\s+", border: str = r"\b") -> str:
    """Any of the phrases between borders; a space of a phrase is any white space, or what `space` says."""
    return border + "(?:" + "|".join(re.escape(p).replace(r"\ ", space) for p in phrases) + ")" + border


def norm_listing(value: Column) -> Column:
    """Lower case, apostrophes removed, signs that part words as spaces; other signs stay. Null is empty."""
    plain = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"['’]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[-_/|,:;()\[\]&+]+", " "), r"\s+", " "))


def comparable(value: Column) -> Column:
    """Lower case, & as and, signs but apostrophes and ½ as spaces: what two records' texts are compared by."""
    plain = F.replace(F.replace(F.lower(F.coalesce(value, F.lit(""))), F.lit("’"), F.lit("'")), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s'½]", " "), r"\s+", " "))


def category_slug(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"[\s&-]+", "_")


def slugify(value: Column, default: str = "item", most: int = 80) -> Column:
    """Marks removed, runs of other characters as one hyphen, none at either end, at most `most` characters, `default` if empty."""
    plain = F.translate(F.lower(F.coalesce(value, F.lit(""))), ACCENTED, UNACCENTED)
    slug = F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, most), r"-+$", "")
    return F.when(slug == "", F.lit(default)).otherwise(slug)


def id_from_slug(value: Column) -> Column:
    """What follows the last '--', null if there is none."""
    return F.when(F.instr(value, "--") > 0, F.substring_index(value, "--", -1))


def display_title(value: Column) -> Column:
    """A title without a final ' — Default' or ' — Default Title'."""
    return F.regexp_replace(value, r"\s+[—-]\s+Default(?: Title)?$", "")


def without_suffix(title: Column, venue: Column) -> Column:
    """A title without a last ' at <venue>' or ' - <venue>' that names its own venue."""
    head, tail = F.regexp_extract(title, r"^(.*?)(?: at | - )([^-]+)$", 1), F.regexp_extract(title, r"^(.*?)(?: at | - )([^-]+)$", 2)
    return F.when((tail != "") & (norm_text(tail) == norm_text(venue)), head).otherwise(title)


def word_set(value: Column, shortest: int = 3) -> Column:
    """Distinct words of at least `shortest` letters, without a publisher."""
    headline = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r" - [^-]*$", "")
    return F.array_distinct(F.filter(F.split(F.regexp_replace(headline, r"[^a-z0-9]+", " "), " "), lambda w: F.length(w) >= shortest))


def title_tokens(value: Column) -> Column:
    return F.array_except(F.array_distinct(F.filter(F.split(norm_text(value), " "), lambda w: w != "")), F.array(*map(F.lit, STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def clean_text(value: Column, most: int | None = None) -> Column:
    """Tags removed, entities resolved, spaces collapsed, cut."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"<[^>]*>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = collapse_spaces(text)
    return F.substring(text, 1, most) if most else text


def trim_to_null(value: Column, most: int) -> Column:
    """Trimmed, then cut; empty is null."""
    return F.nullif(F.substring(F.trim(value), 1, most), F.lit(""))


def contains_folded(columns: list[Column], needle: Column | str, most: int = 100) -> Column:
    """Whether the joined columns hold the first `most` characters of the needle, in any case."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.instr(F.lower(F.concat_ws(" ", *columns)), F.lower(F.substring(needle, 1, most))) > 0


def xml_escape(value: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def rolling_hash(value: Column, n: int) -> Column:
    """h * 31 + code over the characters in 32 bits, modulo n."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF))) % n

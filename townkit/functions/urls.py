"""URL columns: three canonical forms, host groups and safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track visitors.
TRACKING = r"utm_[a-z]+|fbclid|gclid"
SECOND_LABELS = ("ac", "co", "gov", "net", "org")


def identity_url(value: Column) -> Column:
    """For identity keys: no fragment, no slashes at the end, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"#.*$", ""), r"/+$", ""))


def clean_url(value: Column) -> Column:
    """For articles: tracking keys and fragment dropped, all else kept."""
    bare = F.regexp_replace(F.coalesce(value, F.lit("")), r"#.*$", "")
    base, query = F.substring_index(bare, "?", 1), F.when(F.instr(bare, "?") > 0, F.expr("1")).isNotNull()
    pairs = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^(?:{TRACKING})(?:=|$)"))
    return F.when(query & (F.size(pairs) > 0), F.concat(base, F.lit("?"), F.array_join(pairs, "&"))).otherwise(base)


def canonical_link(value: Column) -> Column:
    """For offers: lower host, query keys in order, no fragment, no slash at the end of the path."""
    bare = F.regexp_replace(F.coalesce(value, F.lit("")), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[a-zA-Z]+://[^/?]*", 0))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[a-zA-Z]+://[^/?]*([^?]*)", 1), r"/+$", "")
    pairs = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: p != ""))
    return F.concat(host, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""))


def host(value: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(value, F.lit("")), r"^[a-zA-Z]+://([^/?#:]*)", 1))


def host_group(value: Column) -> Column:
    """The registered part of a host: two labels, three under suffixes like co.uk."""
    labels = F.split(host(value), r"\.")
    wide = F.coalesce(F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LABELS), F.lit(False)) & (F.size(labels) > 2)
    n = F.least(F.when(wide, 3).otherwise(2), F.size(labels))
    return F.array_join(F.slice(labels, -n, n), ".")


def website_identity(value: Column, rejected: tuple[str, ...] = ("facebook.com", "instagram.com", "twitter.com", "x.com")) -> Column:
    """Host without 'www.' and path without the last slash; null for social hosts and other text."""
    name = F.regexp_replace(host(value), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(F.coalesce(value, F.lit("")), r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.when((name != "") & ~name.isin(*rejected), F.concat(name, path))


def is_public_link(value: Column) -> Column:
    """http or https, without credentials."""
    return F.coalesce(value.rlike(r"^https?://[^/?#@\s]+(?:[/?#]\S*)?$"), F.lit(False))


def absolute_url(value: Column, base: Column) -> Column:
    """The value if absolute, else resolved against the base for '/path' and '//host' forms, null otherwise."""
    scheme, root = F.regexp_extract(base, r"^([a-zA-Z]+):", 1), F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]*", 0)
    return (
        F.when(value.rlike(r"^https?://"), value)
        .when(value.startswith("//"), F.concat(scheme, F.lit(":"), value))
        .when(value.startswith("/"), F.concat(root, value))
    )

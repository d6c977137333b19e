"""Loads every module that registers queries."""

from townkit.plans import checks, collection, directory, discovery, editorial, listings, news, offers, places, reports, signals, values  # noqa: F401

"""Importing this registers every query."""

from facetmatch.plans import catalog, catalogue_views, files, gear, matches, rules, searches, texts  # noqa: F401

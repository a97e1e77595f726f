"""Whole jobs: mining a catalog, scoring labelled data."""

"""Operators on data tables and on catalogs of semantic models."""

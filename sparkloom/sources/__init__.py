"""Readers: model archives, report archives and workbooks into catalogs."""

"""Readers for tables, dictionaries, workbooks and templates."""

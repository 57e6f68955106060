"""Relational, fuzzy, spatial and imputation operators."""

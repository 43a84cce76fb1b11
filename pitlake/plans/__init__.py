"""Bindings of the operators to concrete tables, and the catalogue of checked queries."""

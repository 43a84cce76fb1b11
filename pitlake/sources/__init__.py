"""Readers, writers, schema normalisation and nested-payload flattening."""

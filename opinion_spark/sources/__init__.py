"""Readers, writers, named data sets and saved models."""

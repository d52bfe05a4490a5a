"""Readers and writers, and the views over the shared test tables."""

"""Queries over the shared test tables, with their SQL oracles."""

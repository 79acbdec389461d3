"""Registered queries on the mapped test tables and their independent SQL oracles."""

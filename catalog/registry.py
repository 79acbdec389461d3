"""Collects the registered queries of all catalog modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scoring", "committees", "signals", "quotes", "reporting", "records", "merging", "streams", "histories", "stored")


def _merge(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"catalog.{name}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merge("QUERIES")


def oracle_sql() -> dict:
    out = _merge("ORACLES")
    for name in MODULES:
        out.update(import_module(f"catalog.{name}").late_oracles())
    return out

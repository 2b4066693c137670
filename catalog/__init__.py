"""Registered queries: for each name a Spark query and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from catalog import aggregates, ingest, listing, measures, upkeep


def _merged(part: str) -> dict:
    merged: dict = {}
    for module in (ingest, listing, aggregates, measures, upkeep):
        entries = getattr(module, part)
        clash = merged.keys() & entries.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        merged.update(entries)
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")

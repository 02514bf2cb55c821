"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["linededup", "sharding", "warc", "quality", "simhash", "secrets", "preference", "pieces", "decontaminate", "lattice", "idfiles", "filteraudit", "divergence"]


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"threadmill.llm.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")

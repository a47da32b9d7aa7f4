"""Collects the queries and SQL of the engine's modules."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("text", "kg", "retrieval", "learner", "quality", "align", "sources", "streaming", "scheduling", "passages", "evidence", "stores", "demonstration", "learned", "building", "systems", "further")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        for key, value in getattr(importlib.import_module(f"trilune.plans.{module}"), name).items():
            if key in out:
                raise ValueError(f"two queries are called {key}")
            out[key] = value
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")


def flagship(spark, sf_dir: str):
    return queries()["bm25_topk"](spark, sf_dir)

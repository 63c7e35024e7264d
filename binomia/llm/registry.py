"""Queries of the training-data operators, by name."""

from __future__ import annotations

from functools import cache
from importlib import import_module

#: Modules with QUERIES (name to callable of (spark, sf_dir)) and ORACLES (name to DuckDB SQL).
MODULES: tuple[str, ...] = ("q_ogg", "q_shard", "q_warc", "q_lines", "q_simhash", "q_packing", "q_mixing", "q_lm", "q_quality", "q_ann", "q_spelling", "q_dialogue", "q_jaccard")


@cache
def _modules() -> tuple:
    return tuple(import_module(f"binomia.llm.{m}") for m in MODULES)


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.ORACLES
    return out

"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name -> function) and ORACLES (name -> SQL).
MODULES = ("html_text", "mpegts", "pii", "simhash", "licenses", "quality_crf", "mixing", "bpe", "quality_rules", "secrets", "resampling", "superminhash", "hard_negatives")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"inkweave.llm.{name}"), attribute)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")

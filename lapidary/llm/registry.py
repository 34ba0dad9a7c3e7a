"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}

for _name in (
    "op1_toolcalls",
    "op2_wrappers",
    "op3_packing",
    "op4_minhash",
    "op5_mixing",
    "op6_quality",
    "op7_knn",
    "op8_pseudonyms",
    "op9_warc",
    "op10_toxicity",
):
    _module = importlib.import_module(f"lapidary.llm.q_{_name}")
    QUERIES[_name] = _module.query
    if getattr(_module, "ORACLE", None):
        ORACLES[_name] = _module.ORACLE

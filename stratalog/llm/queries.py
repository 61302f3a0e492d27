"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_chosen_path_join": ("op1_chosen_path", "op1"),
    "op2_token_files": ("op2_token_files", "op2"),
    "op3_mixing": ("op3_mixing", "op3"),
    "op4_quality_rules": ("op4_quality", "op4"),
    "op5_license_scan": ("op5_licenses", "op5"),
    "op6_substring_dedup": ("op6_passages", "op6"),
    "op7_fingerprints": ("op7_fingerprints", "op7"),
    "op8_pitman_yor": ("op8_pitman_yor", "op8"),
    "op9_best_fit_packing": ("op9_packing", "op9"),
    "op10_sharding": ("op10_sharding", "op10"),
}


def _query(module: str, name: str):
    return getattr(importlib.import_module(f"{__package__}.{module}"), name)


def queries() -> dict:
    return {key: _query(*where) for key, where in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from .op4_quality import SQL as op4

    return {"op4_quality_rules": op4}

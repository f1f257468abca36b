"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query -> (module, function, name of its SQL in the module or None)
_OPS = {
    "op1_url_filter": ("url_filter", "op1_url_filter", "ORACLE"),
    "op9_pii": ("pii", "op9_pii", None),
    "op4_licenses": ("licenses", "op4_licenses", None),
    "op3_packing": ("packing", "op3_packing", None),
    "op2_sharding": ("sharding", "op2_sharding", None),
    "op8_language_id": ("langid", "op8_language_id", None),
    "op10_fingerprints": ("spotsigs", "op10_fingerprints", None),
    "op6_decontamination": ("decontaminate", "op6_decontamination", None),
    "op5_minhash": ("neardup", "op5_minhash", None),
    "op7_secrets": ("secrets", "op7_secrets", None),
}


def _module(name: str):
    return import_module(f"{__package__}.{name}")


def queries() -> dict:
    return {q: getattr(_module(m), f) for q, (m, f, _) in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    return {q: getattr(_module(m), sql) for q, (m, _, sql) in _OPS.items() if sql}

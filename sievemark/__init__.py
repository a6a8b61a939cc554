"""Scans of texts for sensitive content, figures over the events of such scans, and data preparation, as PySpark DataFrames.

The names that most users need are exported here; they are imported when they are first asked for.
"""

from importlib import import_module

_EXPORTS = {
    "scan": "plans.scan",
    "prompts": "plans.scan",
    "event_of": "plans.scan",
    "organisation_patterns": "plans.scan",
    "custom_threats": "plans.custom",
    "PATTERNS": "functions.dictionary",
    "Pattern": "functions.dictionary",
    "CATEGORIES": "functions.dictionary",
    "VALIDATORS": "functions.dictionary",
    "risk_level": "operators.scoring",
    "redact": "operators.redact",
    "merge_spans": "operators.redact",
    "Store": "sources.store",
    "get_spark": "session",
}
__all__ = list(_EXPORTS)


def __getattr__(name: str):
    if name in _EXPORTS:
        return getattr(import_module(f".{_EXPORTS[name]}", __name__), name)
    raise AttributeError(name)

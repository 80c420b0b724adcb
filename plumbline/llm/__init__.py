"""Operations of a training-data pipeline. Nothing outside imports this subpackage."""

from __future__ import annotations

import importlib

_MODULES = ["matching", "names", "neardup", "consensus", "topn", "crosssplit", "packing", "leakage", "quality"]


def modules():
    """Modules that offer queries() and oracle_sql()."""
    return [importlib.import_module(f"{__name__}.{m}") for m in _MODULES]

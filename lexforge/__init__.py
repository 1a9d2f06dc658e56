"""Corpus preparation on Spark. The public names are those of ``lexforge.api``."""

from __future__ import annotations

import importlib

__version__ = "0.2.0"


def __getattr__(name: str):
    # on first use: Python workers import operators of this package, not all of it
    if name.startswith("__") or name == "api":
        raise AttributeError(name)
    return getattr(importlib.import_module("lexforge.api"), name)


def __dir__() -> list[str]:
    return ["__version__", *importlib.import_module("lexforge.api").__all__]

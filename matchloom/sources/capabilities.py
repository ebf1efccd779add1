"""What is installed, and the backend that follows from it."""

from __future__ import annotations

import os

from matchloom.sources.providers import KEYS, PACKAGES, available

#: Optional packages by the name they are asked for.
OPTIONAL = {"sentence_transformers": "sentence_transformers", "fastembed": "fastembed", "openai": "openai", "gemini": "google.generativeai", "rapidfuzz": "rapidfuzz", "faiss": "faiss", "numba": "numba"}


def check_optional_dependencies(verbose: bool = False) -> dict[str, bool]:
    found = {name: available(package) for name, package in OPTIONAL.items()}
    if verbose:
        for name, there in found.items():
            print(f"{name}: {'available' if there else 'not installed'}")
    return found


def best_backend(prefer_cpu: bool = False) -> str:
    """Local models first, then services that have a key. The scorers here need no package, so that there is always one to fall back on."""
    order = (["fastembed"] if prefer_cpu else []) + ["sentence-transformer", "fastembed", "openai", "google"]
    usable = lambda name: available(PACKAGES[name]) and (name not in KEYS or bool(os.environ.get(KEYS[name])))
    return next((name for name in order if usable(name)), "fuzzy")


def fuzzy_library() -> dict[str, object]:
    from matchloom.functions.kernels import SCORERS

    return {"primary": "matchloom", "algorithms": list(SCORERS), "rapidfuzz_available": available("rapidfuzz")}

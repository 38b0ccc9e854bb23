"""Functions for Python workers, found there by name.

Modules with caches (vocabularies, words) must be imported once per worker, not pickled with
every task; a worker that was not started in this folder also needs the path to it.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark import cloudpickle

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# What `task` returns travels whole, so that it can run before anything here can be imported.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def task(function: Callable, *args) -> Callable:
    """A function over batches: ``function`` itself, or what it makes of ``args`` (plain values)."""
    module, name, root = function.__module__, function.__name__, ROOT

    def run(batches):
        import importlib
        import sys

        import pyarrow

        if root not in sys.path:
            sys.path.append(root)
        found = getattr(importlib.import_module(module), name)
        yield from (found(*args) if args else found)(batches)
        pyarrow.default_memory_pool().release_unused()  # idle workers keep only their caches

    return run

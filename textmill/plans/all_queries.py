"""Imports every query module so that its queries register."""

import importlib
import traceback

MODULES = ["q_text", "q_stats", "q_sampling", "q_vocab", "q_embed", "q_eval", "q_models", "q_io"]

# module name -> traceback of a module that could not be imported
FAILED: dict[str, str] = {}


def load() -> None:
    """Import every module; one that fails is recorded in ``FAILED`` and
    printed, and leaves the others' queries in place."""
    for m in MODULES:
        if m in FAILED:
            continue
        try:
            importlib.import_module(f"textmill.plans.{m}")
        except Exception:  # noqa: BLE001
            FAILED[m] = traceback.format_exc()
            print(f"textmill.plans.{m} did not load:\n{FAILED[m]}")

"""Registered queries; load_all() imports every module that registers some."""

import importlib

MODULES = ["training", "trace_queries", "spike_queries", "network_queries", "sample_queries", "numeric_queries", "stream_queries", "composed_queries"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"glimmerframe.plans.{name}")

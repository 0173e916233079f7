"""granary: table consolidation, stratified splits, feature matrices, model
evaluation and run telemetry as plain ``DataFrame -> DataFrame`` functions on Spark."""

from granary.session import build_session

__all__ = ["build_session"]

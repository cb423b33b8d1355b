"""Retrieval, reranking, fusion and evaluation as Spark DataFrame operators."""

from rankloom.config import Config, DEFAULTS

__all__ = ["Config", "DEFAULTS"]

# Task functions travel by value, so executors need no copy of this package.
import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

"""Structured-data generation, validation and run analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from quern.session import build_session, configure

# Functions that run in Python workers travel with their code, so the package
# need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "configure"]

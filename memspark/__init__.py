"""Memory records on Spark: validate, embed, merge, search and browse them as DataFrames."""

import sys

from pyspark import cloudpickle

from memspark.options import Options

# Functions of this package travel with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Options"]

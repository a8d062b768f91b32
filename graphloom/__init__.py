"""Subgraph analytics on very large weighted graphs, as DataFrame-in, DataFrame-out Spark operators."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

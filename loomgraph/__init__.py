"""loomgraph: document-graph retrieval and corpus operators as PySpark plans."""

import sys

from pyspark import cloudpickle

# functions of this package go to the executors by value, so that it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

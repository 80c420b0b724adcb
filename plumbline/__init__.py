"""plumbline: a Spark-native engine for document-retrieval benchmarks and text collections.

Functions that run in Python workers are shipped with the task, so executors
need the third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

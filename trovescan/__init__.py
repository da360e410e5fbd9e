"""Retrieval analytics on Spark DataFrames.

``functions``  column expressions (text, vectors)
``sources``    readers and writers of the stored tables
``operators``  DataFrame -> DataFrame steps (chunks, ids, search, metrics, selection)
``plans``      the steps put together, and the registered queries
"""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: the helpers a task uses travel with it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Market-signal and regime analytics on Spark DataFrames.

Layers:

* ``functions``  column expressions (scalars, rolling windows)
* ``operators``  DataFrame -> DataFrame operators (vintages, joins, signals, ...)
* ``sources``    readers, normalisers and sinks
* ``plans``      registered queries over the TPC-H-shaped test tables
"""
import sys

from pyspark import cloudpickle

# the few grouped maps travel with their helpers, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

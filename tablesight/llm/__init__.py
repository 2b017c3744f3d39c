"""Training-data operators: deduplication, filters, scoring, mixing, packing.

Functions that run inside Spark tasks are shipped by value, so executors need
numpy and pyarrow but not this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Privacy, provenance and training-data analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions for Arrow workers travel with their tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Designed-experiment analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel to the executors by value, so that a job does not
# depend on this package being installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

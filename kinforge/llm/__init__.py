"""Training-data operators.  Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Kernels travel with the tasks, so executors need no copy of this repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

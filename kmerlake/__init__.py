"""Words, motifs and evidence over sequences on Spark."""

import sys

from pyspark import cloudpickle

# Kernels travel inside the task closures, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

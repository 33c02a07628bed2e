"""Network-slice traffic analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

from slicelens.settings import BY_STEM, TREE, WindowSpec

# The two helpers that run in Python workers travel with the job, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["BY_STEM", "TREE", "WindowSpec"]

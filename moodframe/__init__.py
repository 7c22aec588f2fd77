"""Text and vector classification analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task functions of this package travel with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

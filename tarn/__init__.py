"""tarn: batch retrieval, search analytics and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are shipped with the job, so executors
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

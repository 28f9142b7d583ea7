"""passel: corpus preparation and vector retrieval as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The package's functions travel with the jobs, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Daily market, macro and news analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks travel with the job, so the
# executors need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

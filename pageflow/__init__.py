"""pageflow: web-content retrieval as Spark jobs.

Everything is DataFrame in, DataFrame out.  See README.md for the module map.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so that
# executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

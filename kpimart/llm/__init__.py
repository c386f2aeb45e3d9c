"""Training-data operators for large corpora, and their queries.

Functions that run inside Spark's Python tasks are shipped by value, so the
executors need NumPy, pandas and Arrow but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

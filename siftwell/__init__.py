"""A Spark-first engine that scores text, tracks reputation and prepares training corpora."""

import sys

from pyspark import cloudpickle

# Executors receive this package's functions by value, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

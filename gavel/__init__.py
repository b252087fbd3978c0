"""Model judgments as Spark SQL functions and DataFrame operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Worker-side functions travel by value, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

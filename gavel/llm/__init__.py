"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it.  Worker-side functions are pickled by value, so executors need
neither this package on their path nor a shared file system for code.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

"""Operators for building training corpora: cleaning, deduplication, scoring and packing of text.

Nothing else in the library imports this subpackage. Its functions are sent to Python workers by value, so the workers
need not have the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

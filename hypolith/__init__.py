"""Hypolith: a Spark-native engine that tests declarative signal hypotheses on tabular, text and event data.

Its Python functions are sent to workers by value, so that workers need not have the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

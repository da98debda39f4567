"""Operators for preparing training text. Nothing outside this package imports it.

Functions that run on executors are pickled by value, so a cluster needs no copy of this package.
"""

from pyspark import cloudpickle

import granary

cloudpickle.register_pickle_by_value(granary)

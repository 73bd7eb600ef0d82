"""Operators for preparing training text. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the plan, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

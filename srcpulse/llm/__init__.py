"""Operators of a training-data pipeline: one module each, their queries in `queries`."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks travel with their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

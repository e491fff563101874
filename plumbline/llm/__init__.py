"""Operators of a large-scale training-data pipeline. Nothing outside this package imports it."""

import plumbline
from pyspark import cloudpickle

# Functions that run on executors travel with the job, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(plumbline)

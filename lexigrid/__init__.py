"""Catalog analytics on Spark: enumerations, name vectors, clusters, topics, places."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from lexigrid.functions import register  # noqa: E402

__all__ = ["register"]

"""Dependency-graph analytics over Spark tables of tasks and edges."""

import sys

from pyspark import cloudpickle

# Grouped functions travel to executors with their helpers, so nothing needs installing there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

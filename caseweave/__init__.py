"""Spark jobs for reconstructing hidden stretches of case logs and scoring the answers."""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel with the plan, so executors need no copy of
# this package and a session may be started from any folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Spark-native analytics over trajectories, rankings, sequences and text corpora."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the task, so they need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules["quillstone"])

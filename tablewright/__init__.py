"""Tabular machine-learning analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from tablewright.core import TaskSpec, normalise_missing, resolve_task

# Ship the few Arrow functions inside the task itself, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["TaskSpec", "normalise_missing", "resolve_task"]

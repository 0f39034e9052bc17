"""Document knowledge graphs as Spark tables: build them, search them, ask them."""

import sys

from pyspark import cloudpickle

from quire.config import Config, load
from quire.session import get_session

# Task helpers travel with the task, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Config", "get_session", "load"]

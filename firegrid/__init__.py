"""firegrid: fire-regime and land-climate analytics on Spark long tables."""

import sys

from pyspark import cloudpickle

from firegrid.grid import CELL, GridSpec

# functions sent to Python workers travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["CELL", "GridSpec"]

"""Per-position count tables and genomic intervals as Spark DataFrames."""

import sys

from pyspark import cloudpickle

from lociframe.session import get_session

# functions shipped to executors travel by value: the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]

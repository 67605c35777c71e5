"""precis: text-summarisation corpus preparation and scoring on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Ship this package's functions (UDF bodies, mapInPandas closures) to the Python
# workers by value, so executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from .options import DEFAULT, Options  # noqa: E402,F401

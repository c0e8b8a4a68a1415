"""repalign: comparing keyed vectors from different sources as Spark jobs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Task functions travel with their code, so executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

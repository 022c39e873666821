"""Stack analytics on Spark: robust aggregation, calibration, registration and review of aligned numeric frames."""

from pyspark import cloudpickle as _cloudpickle

# Kernels travel to the executors by value, so a cluster needs no installed copy of this package.
_cloudpickle.register_pickle_by_value(__import__(__name__))

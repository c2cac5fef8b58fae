"""LiDAR point clouds on Spark: points, patches, two-phase retrieval."""

import sys

from pyspark import cloudpickle

# Python workers do not see the driver's sys.path. Functions and data sources of
# this package travel by value, so a job runs where the package is not installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

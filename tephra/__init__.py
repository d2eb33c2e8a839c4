"""Spark-native analytics of gridded, gap-ridden observations and the series made of them."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

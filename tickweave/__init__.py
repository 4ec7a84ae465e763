"""Spark-native analytics for trades, price ticks, participants and scheduled events."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package by value, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

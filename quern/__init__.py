"""quern: time-series, similarity, full-text, log and corpus operators as Spark plans."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

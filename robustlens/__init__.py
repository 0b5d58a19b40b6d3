"""robustlens: robustness analytics over score, spectrum and mask tables, as Spark DataFrame jobs."""
import sys

from pyspark import cloudpickle

# tasks carry the package's small kernels with them, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

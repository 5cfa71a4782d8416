"""Document-ledger analytics as PySpark DataFrame operators."""
import sys

from pyspark.cloudpickle import cloudpickle

# UDFs travel to the executors by value, so a cluster needs no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

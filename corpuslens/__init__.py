"""corpuslens: mining document and source-code corpora with PySpark."""

import sys

from pyspark import cloudpickle

# Python functions reach the tasks by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

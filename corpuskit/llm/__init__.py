"""Training-data pipeline operators (independent of the rest of the library).

Each module holds one operator with its own general interface; ``queries.py``
holds the thin registered queries.  The package is pickled by value, so
executors need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

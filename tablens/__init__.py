"""tablens: dataset profiling, feature preparation, clustering and table operations as Spark jobs."""

import sys as _sys

__version__ = "0.1.0"

try:
    # Ship this package's code inside pickled task closures, so executors need no
    # installed copy (applyInPandas / mapInPandas functions live in this package).
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older pickler: the package must then be on the executors' path
    pass

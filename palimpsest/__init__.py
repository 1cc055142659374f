"""palimpsest: document-version comparison on Spark.

Python functions that run on executors (the Arrow kernels, the office-file parser) are pickled by
value, so workers need no copy of this package on their path.
"""

import sys as _sys

try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without pickle-by-value
    pass

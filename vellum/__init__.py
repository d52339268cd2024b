"""vellum: prompt/response table analytics as Spark DataFrame jobs.

Python-side helpers used inside tasks (Arrow UDFs, ``mapInPandas`` callables)
are pickled by value, so executors need no installed copy of this package.
"""

import sys

try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

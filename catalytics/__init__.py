"""Catalytics: product-catalogue analytics as Spark DataFrame jobs.

Sub-packages:

* ``functions``  - pure ``Column -> Column`` parsers and text rules
* ``sources``    - schemas, CSV / JSON / HTML ingest, sinks
* ``operators``  - listing, variant, statistics, ML and retrieval operators
* ``plans``      - driver-table fixtures and the registered query catalogue
* ``streaming``  - incremental refresh of appended files
"""

import sys as _sys

__version__ = "0.1.0"

# Functions that run inside Python workers (HTML parsing, number formatting) are
# shipped with the task by value, so executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pickler: rely on --py-files instead
    pass

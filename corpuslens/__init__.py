"""corpuslens: Spark-native operators for measuring how group attributes show up in text corpora.

Every public operator is a plain function ``DataFrame -> DataFrame`` (or a ``Column`` expression),
built from Spark SQL / DataFrame primitives so Catalyst and AQE plan the physical work.
"""

import sys as _sys

from corpuslens.session import build_session, checkpoint_dir  # noqa: F401


def _ship_by_value() -> None:
    """Python functions of this package that run inside tasks (the mapInPandas scorer path) are pickled by
    value, so executors need not have the package installed or on their path."""
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # older cloudpickle: fall back to by-reference pickling
        pass


_ship_by_value()

__all__ = ["build_session", "checkpoint_dir"]

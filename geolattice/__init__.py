"""Spatial retrieval and coverage analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors by value, so that workers need no
# copy of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .operators.retrieval import FeatureStore  # noqa: E402
from .sources.geoparquet import BBox, FileEntry, FileIndex  # noqa: E402

__all__ = ["BBox", "FeatureStore", "FileEntry", "FileIndex"]

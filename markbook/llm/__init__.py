"""Operators for preparing training data at corpus scale. Nothing else in the library imports this package.

Functions that run in tasks travel with their code, so executors need Spark's Python and the libraries named in the README,
not a copy of this repository.
"""

import importlib

from pyspark import cloudpickle

for _name in ("common", "crosstok", "packing", "quality", "secrets", "simhash", "substrings", "toxicity", "vectors", "warc", "whitening"):
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))

"""Operators of a training-data pipeline: archives, quality, packing, encoding, extraction, fingerprints, near copies,
language, licences.  Nothing else in the library imports this subpackage.

Functions that run in Python workers travel with the job (pickled by value), so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Consortial library-catalogue analytics as lazy PySpark DataFrames.

``Lake`` holds the input tables; every function in ``shelftally.operators`` and
``shelftally.plans`` takes a lake (or another DataFrame) and returns a DataFrame.
"""

from shelftally.params import Params
from shelftally.sources.lake import Lake

__all__ = ["Lake", "Params"]

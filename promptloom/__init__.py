"""promptloom: retrieval-augmented prompt datasets as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver except values whose size is checked first (see
``operators.knn`` and ``operators.bm25``).
"""

__version__ = "0.1.0"

"""sheaf: ledger analytics on Spark.

Every public operator is a ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, so that it composes with ``DataFrame.transform`` and
runs for every company (``by=["Company_ID"]``) in one pass.
"""

__version__ = "0.1.0"

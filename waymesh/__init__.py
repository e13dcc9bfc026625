"""Waymesh: batch-first analytics over road and transit networks on PySpark.

Every operation takes DataFrames and returns DataFrames; nothing here needs a
service process.  Import the parts you need::

    from waymesh.operators import proximity, orphans
    from waymesh.functions import geo
"""

__version__ = "0.1.0"

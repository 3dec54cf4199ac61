"""corpuskit: PySpark DataFrame operators for corpus preparation, response
evaluation, run telemetry and edge tables.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function built from Spark SQL expressions, joins, windows and Structured
Streaming, so Catalyst can prune, push down and plan it.
"""

__version__ = "0.1.0"

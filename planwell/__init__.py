"""planwell: Spark-native volume forecasting and site recommendation.

Start with ``planwell.api`` (endpoint-equivalent functions) or the query
registry in ``planwell.plans.catalog`` (``QUERIES`` / ``ORACLE``).
"""

__version__ = "0.1.0"

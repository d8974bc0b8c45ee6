"""logloom: log collection, search and live tail as Spark DataFrame and
Structured Streaming jobs.

Modules: ``functions`` (Column scalars), ``operators`` (DataFrame → DataFrame
operators), ``sources`` (stored table and fixture inputs), ``streaming``
(streaming queries), ``plans`` (the registered queries and their oracles).
"""

__version__ = "0.1.0"

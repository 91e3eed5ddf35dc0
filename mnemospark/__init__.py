"""mnemospark: analytics over a store of short text memories, as Spark jobs.

The package is split by concern:

* ``sources``    reading, binding and writing tables
* ``functions``  column expressions (text, vectors, time, scoring)
* ``operators``  DataFrame -> DataFrame operators (retrieval, graphs, metrics, maintenance)
* ``plans``      composed pipelines and the registered queries with their SQL twins
* ``streaming``  Structured Streaming versions of the event-log operators
* ``llm``        training-data operators; nothing outside that folder imports it
"""

__version__ = "0.1.0"

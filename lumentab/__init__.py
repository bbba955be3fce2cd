"""lumentab: table, catalogue and text analytics written as Spark jobs.

Every operator takes and returns a Spark ``DataFrame``.  The sub-packages are

``functions``  column expressions (strings, patterns, dates, numbers, arrays, sky)
``operators``  DataFrame to DataFrame transformations
``sources``    readers, ``sinks`` writers
``streaming``  the row-wise operators on a streaming DataFrame
``plans``      the registered queries with their SQL twins
"""

__version__ = "0.1.0"

"""Perpetual-futures carry analytics as Spark jobs.

Sub-packages:

* ``functions``  column expressions (parsing, buckets, display text, classes)
* ``sources``    landed exchange payloads, normalisers, Parquet warehouse
* ``operators``  DataFrame -> DataFrame building blocks
* ``plans``      user-level jobs and the registered queries
* ``streaming``  Structured Streaming counterparts
"""

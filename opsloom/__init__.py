"""Spark jobs for retrieval corpora, bulk hybrid retrieval and operations logs.

Every operator is a function from DataFrames to a DataFrame.  ``functions``
holds column expressions, ``operators`` the relational jobs, ``sources`` the
readers and writers, ``streaming`` the Structured Streaming forms and
``plans`` the registered queries.
"""

__version__ = "0.1.0"

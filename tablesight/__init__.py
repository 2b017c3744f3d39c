"""tablesight: dataset profiling, comparison and preparation as Spark jobs.

Every public operator takes DataFrames and returns a DataFrame built from
built-in Spark expressions, so Catalyst plans and optimises the whole job.
"""

__version__ = "0.1.0"

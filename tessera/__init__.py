"""tessera: image-dataset preparation, training and evaluation as Spark jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or returns a small
tuple of DataFrames) whose work runs on the executors.  Randomness comes from
md5 hashes of stable ids, so a re-run or a retried task gives the same rows.
"""

__version__ = "0.1.0"

"""shopsight: retail and marketing analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames (models return a fitted
Spark ML model together with a metrics DataFrame).  Nothing is collected to the
driver except small, size-bounded statistics (a handful of medians, bucket
boundaries, model weights).
"""

__version__ = "0.1.0"

"""Point-in-time equity research as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames. Nothing in an operator
collects rows; the only driver-side values are parameters.
"""

__version__ = "0.1.0"

"""factlake: shared pools of short text facts as Spark DataFrame operators.

Every operator takes and returns DataFrames, so a caller composes them freely
and Catalyst plans the whole job.  See README.md for the map of modules.
"""

__version__ = "0.1.0"

"""govspark: data-governance analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns DataFrames. Wall-clock time
is never read: rules that depend on age take an explicit ``as_of`` value.
"""

__version__ = "0.1.0"

"""kindred: entity resolution, and tuning of it, as Spark DataFrame operators.

Every public function takes DataFrames and returns DataFrames.  Nothing below
this package keeps session state; the only collected values are scalars and
model parameters.
"""

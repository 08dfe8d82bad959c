"""Filing-keyword and price analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames (or Columns); nothing in the
core paths collects to the driver. ``as_of`` dates are always parameters.
"""

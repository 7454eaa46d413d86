"""Spark-native report and data-movement operators.

Every public function takes DataFrames and plain parameters (dates included, there is
no hidden clock) and returns a lazy DataFrame or Column.
"""

"""Customer-retention analytics on Spark DataFrames.

Every public function takes DataFrames (and an explicit ``as_of`` date where time
matters) and returns a lazy DataFrame or Column.
"""

"""foundling: listing aggregation on Spark DataFrames.

Subpackages: ``functions`` (Column -> Column), ``operators`` (DataFrame ->
DataFrame), ``sources`` (readers and writers), ``streaming`` (incremental
ledger), ``plans`` (the registered queries over the test tables).
"""

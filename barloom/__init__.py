"""Market-research analytics on Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and writers), ``plans`` (whole studies and the
query catalogue) and ``streaming`` (incremental jobs).
"""

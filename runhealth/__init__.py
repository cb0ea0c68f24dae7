"""Run-health analytics on Spark.

Questions an operations team asks about job runs, answered over whole tables
of runs, logs, clusters, activity, API calls and chat turns.

``functions``  Column -> Column expressions (classification, remedies, text)
``operators``  DataFrame -> DataFrame (joins, windows, rollups, as-of checks)
``sources``    typed readers, log-text parsing, sinks
``streaming``  Structured Streaming versions of the record-at-a-time checks
``plans``      compositions, test-table bindings and the query catalogue
"""

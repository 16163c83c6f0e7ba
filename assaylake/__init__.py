"""Laboratory-measurement analytics as Spark DataFrame functions.

``functions``  Column -> Column helpers
``operators``  DataFrame -> DataFrame operators (staging, marts, history, diff, quality, text)
``sources``    reading and validating extraction files, raw tables, exports
``plans``      reports, standard questions and the load-transform-report workflow
``streaming``  incremental loading of a growing directory
"""

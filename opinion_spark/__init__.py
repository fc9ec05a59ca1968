"""Opinion analytics on large collections of short texts, written for Spark.

Sub-packages
------------
functions   Column -> Column helpers (text cleaning, encodings, vector arithmetic)
operators   DataFrame -> DataFrame operators
sources     readers, writers, named data sets, saved models
plans       end-to-end flows built from the operators
"""

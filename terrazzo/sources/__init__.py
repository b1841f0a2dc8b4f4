"""Readers and writers of scene files. Files are read through Spark, one row a file, so any store
that Spark opens will do; parsing runs on the executors."""

"""Document-signal analytics on Spark: located, classified observations over document corpora."""

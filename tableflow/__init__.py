"""tableflow: table synchronisation and streaming table jobs on PySpark."""

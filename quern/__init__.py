"""quern: a Spark-first analytics engine for tables of web pages, documents and event logs."""

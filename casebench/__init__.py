"""casebench: case files, retrieval and findings as Spark DataFrames."""

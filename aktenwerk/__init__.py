"""Citations, personal data, briefings and custody chains of large collections of letters, as Spark DataFrames."""

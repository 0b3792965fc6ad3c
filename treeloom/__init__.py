"""Query and transform semi-structured documents with Spark DataFrames."""

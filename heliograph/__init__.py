"""heliograph: retrieval, behaviour analytics and corpus operators on Spark DataFrames."""

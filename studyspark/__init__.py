"""studyspark: routing, diagnosis, rubric scoring, spaced review and learned text routing on Spark DataFrames."""

"""evspark: security-event analytics and training-data operators on Spark DataFrames."""

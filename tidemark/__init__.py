"""Point-in-time analytics for event, quote, bar and forecast data, on Spark DataFrames."""

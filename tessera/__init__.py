"""Analytics over research awards, swipes, telemetry and texts, written with Spark DataFrames."""

"""Analytics of review text about places, as operators from DataFrame to DataFrame."""

"""Association summary statistics on Spark: joins, sampling, features, models and tests."""

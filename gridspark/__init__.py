"""gridspark: desktop-database query definitions and their analytics, run on Spark."""

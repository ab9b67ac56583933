"""Product-catalogue matching and training-data preparation as PySpark jobs."""

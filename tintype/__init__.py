"""Spark-first engine for image-dataset tables: intake, cleaning, audit, splits, release and image jobs."""

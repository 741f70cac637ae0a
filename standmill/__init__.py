"""Point-cloud jobs as Spark DataFrame plans."""

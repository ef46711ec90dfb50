"""novelspark: metric novelty and coverage analytics as Spark DataFrame plans."""

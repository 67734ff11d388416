"""Text-pair curation, shaping, scoring and conversion as Spark jobs."""

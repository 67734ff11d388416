"""Column builders. Nothing in here triggers a job."""

"""Column-level helpers; nothing here starts a job."""

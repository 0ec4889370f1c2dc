"""DataFrame → DataFrame operators of a job."""

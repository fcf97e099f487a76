"""DataFrame-to-DataFrame operators; none of them starts a job."""

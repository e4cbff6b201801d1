"""DataFrame operators over message corpora."""

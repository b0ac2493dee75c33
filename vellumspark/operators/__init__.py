"""DataFrame-to-DataFrame operators over document corpora."""

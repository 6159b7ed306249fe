"""DataFrame -> DataFrame steps, for `df.transform(...)`."""

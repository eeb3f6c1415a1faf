"""Sessions, dispatch and parameter records."""

"""Documents and stores."""

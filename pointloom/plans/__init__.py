"""Point-cloud plans."""

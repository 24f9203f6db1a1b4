"""Point-cloud functions."""

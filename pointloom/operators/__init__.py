"""Point-cloud operators."""

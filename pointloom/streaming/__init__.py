"""Point-cloud streaming."""

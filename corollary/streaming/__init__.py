"""Changes instead of whole relations."""

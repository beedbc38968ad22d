"""Where documents come from and are kept."""

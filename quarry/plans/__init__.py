"""From a request to a plan."""

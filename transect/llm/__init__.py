"""Training-corpus operators. Nothing else in ``transect`` imports this subpackage."""

"""User-visible reports, composed from the operators."""

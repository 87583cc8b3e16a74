"""Private releases built from the operators."""

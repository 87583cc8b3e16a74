"""DataFrame operators: plain functions from frames to frames."""

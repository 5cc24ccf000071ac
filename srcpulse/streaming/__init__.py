"""Live forms of the batch operators."""

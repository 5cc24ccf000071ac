"""Pure column expressions: no action, no shuffle."""

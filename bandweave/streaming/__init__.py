"""The band join on streams."""

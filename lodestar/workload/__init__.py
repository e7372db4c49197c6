"""The registered queries over the driver tables, and the same in SQL."""

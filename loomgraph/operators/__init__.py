"""Graph operators over DataFrames: every solution row carries its record id, and every join includes it."""

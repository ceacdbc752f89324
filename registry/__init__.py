"""The queries the engine answers over the given tables, with equivalent SQL."""

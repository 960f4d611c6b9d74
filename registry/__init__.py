"""The engine's operators over the given tables, each with equivalent SQL where there is one."""

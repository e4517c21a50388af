"""Registered queries: every operator run over whole tables, with an equivalent SQL text each."""

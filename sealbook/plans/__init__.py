"""Whole jobs made of operators: proofs, invoices, the registered queries and their SQL."""

"""Operators that need language or learned models. Nothing outside this folder imports it."""

"""Operators over requests, responses and stores."""

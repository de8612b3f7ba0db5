"""Verification operators over relations."""

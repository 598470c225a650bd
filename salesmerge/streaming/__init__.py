"""Applying newly landed reports to the stored sales."""

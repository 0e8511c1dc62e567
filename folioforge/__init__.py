"""Part of the folioforge engine."""

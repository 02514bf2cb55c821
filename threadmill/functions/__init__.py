"""Part of threadmill."""

"""Part of clonoscape."""

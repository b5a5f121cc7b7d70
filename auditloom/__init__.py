"""Change-audit analytics as DataFrame plans."""

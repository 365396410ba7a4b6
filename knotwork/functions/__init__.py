"""Part of knotwork."""


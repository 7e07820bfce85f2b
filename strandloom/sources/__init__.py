"""Files and derived views that operators read."""

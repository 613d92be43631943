"""News-story analytics as DataFrame transforms."""

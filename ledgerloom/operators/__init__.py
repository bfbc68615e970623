"""Layout and row operators over words grouped by page."""

"""lumenrow: composable DataFrame operators for text, subtitle and media-metadata analytics."""

__version__ = "0.1.0"

"""The formats: blocks, the byte container, tar trees."""


class FormatError(ValueError):
    """Malformed coded data or archive."""

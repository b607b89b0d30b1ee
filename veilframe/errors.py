"""Errors a caller can handle."""


class VeilError(Exception):
    """Base of all below."""


class UnsupportedFormatError(VeilError):
    """The file's extension names no format that can be read."""


class InvalidInputError(VeilError):
    """The input can't be profiled as it is."""

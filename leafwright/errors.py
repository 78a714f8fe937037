"""Errors of calls on a single book. Calls on a corpus give a status column instead."""


class LeafwrightError(Exception):
    """Base of all errors of this package."""


class NotABookError(LeafwrightError):
    """The file is missing or is no packaged book."""


class ProtectedError(LeafwrightError):
    """The book's text is encrypted."""


class AnchorError(LeafwrightError):
    """No chapter or block fits an anchor or title."""


class TocError(LeafwrightError):
    """A table of contents can't be used."""


class PatternError(LeafwrightError):
    """A search pattern can't be read."""

"""Failures whose message is complete for the user; all else is told with its type."""


class Told:
    """Marks an exception whose message stands alone."""


class BadInput(Told, ValueError):
    """Something given can't be used."""


class Missing(Told, FileNotFoundError):
    """A file that a step needs is not there."""


class Failed(Told, RuntimeError):
    """A step did not do its work."""

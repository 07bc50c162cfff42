"""What can be wrong with a request."""


class QuarryError(Exception):
    """Anything that a caller can do something about; ``status`` is its HTTP status."""

    status = 500


class InvalidQuery(QuarryError):
    """A query that has no meaning: an unknown field, a negative page, a blank id."""

    status = 422


class UnknownIndex(QuarryError):
    """No index has this name."""

    status = 400


class NotFound(QuarryError):
    """No block or entity has this id."""

    status = 400

"""Errors. Those about a caller's values are ValueErrors as well."""


class PointloomError(Exception):
    """Root of all errors here."""


class InvalidPointError(PointloomError, ValueError):
    pass


class InvalidVectorError(InvalidPointError):
    pass


class InvalidFilterError(PointloomError, ValueError):
    pass


class CollectionExistsError(PointloomError):
    pass


class CollectionNotFoundError(PointloomError):
    pass


class SchemaMismatchError(PointloomError):
    pass


class WriteConflictError(PointloomError):
    """Another writer published meanwhile. The check comes before the rename, not with it: it finds what a second writer
    has done, but two that publish in the same instant need a lock of their own."""


class SnapshotError(PointloomError):
    pass


class ClosedResourceError(PointloomError):
    pass


class PayloadIndexError(PointloomError):
    """An index of a path that is none, of an unknown type, or of another type than the path's index has."""


class CorruptionError(PointloomError):
    """What a collection keeps of itself can't be read, or does not fit together."""

"""What can go wrong in a store."""


class StoreError(Exception):
    """Base of all errors of adapters and stores."""


class ConfigurationError(StoreError, ValueError):
    """Settings that can't hold together."""


class NotConnectedError(StoreError):
    """Used before connect() or after disconnect()."""


class NotFoundError(StoreError, KeyError):
    """No record of that key."""


class DimensionMismatchError(StoreError, ValueError):
    """A vector of another length than the store's."""

    def __init__(self, expected: int, actual: int):
        super().__init__(f"dimension mismatch: expected {expected}, got {actual}")
        self.expected, self.actual = expected, actual


class SerializationError(StoreError, ValueError):
    """Bytes or JSON that can't be read or written."""


class OperationError(StoreError):
    """The backend refused or failed."""

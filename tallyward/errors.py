"""Errors the operators raise."""


class DataCleaningError(Exception):
    """A mapped column still holds nulls after cleaning."""


class InsufficientDataError(Exception):
    """A run has too few rows left after cleaning."""


class MissingRoleError(Exception):
    """A column an operator needs was not mapped."""

"""Errors raised while a plan is being built."""

from __future__ import annotations


class GaroaError(Exception):
    """Base of every error of this package."""


class ValidationError(GaroaError, ValueError):
    """Parameters or filters that contradict each other."""


class GridReadError(GaroaError):
    """A grid table lacks a column it needs, or the axes share no time step."""


class MissingVariableError(GridReadError):
    """The requested climate variable is not in the table."""


class EmptyFolderError(GridReadError):
    """A grid folder holds no data files."""


class InconsistentScenarioError(GridReadError):
    """A file belongs to another scenario than the one asked for."""


class ConfigurationError(GaroaError):
    """A dimension table lacks its identifying columns."""


class NotFoundError(GaroaError, KeyError):
    """The requested municipality has no mapped cell."""


class ExportLimitError(GaroaError):
    """An export would exceed the agreed number of rows."""


class DuplicateKeyError(GaroaError):
    """A table that must be unique on a key is not."""

"""Errors raised on the driver, before or instead of a result."""

from __future__ import annotations


class InvalidQuery(ValueError):
    """The requested combination cannot be answered; the message says why."""


class NoRows(ValueError):
    """No row survived the requested filters."""


class MissingColumns(KeyError):
    """A column the operator needs is not in the frame."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""

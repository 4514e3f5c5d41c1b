"""Errors of the library."""


class ContractError(ValueError):
    """Input or configuration that breaks a table's or operator's contract."""

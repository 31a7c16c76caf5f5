"""Errors a user can act on."""


class MergeInputError(ValueError):
    """A file, plan or recipe can't be used; the message says why."""

"""Errors that a statement's author can mend."""


class SemanticError(ValueError):
    pass

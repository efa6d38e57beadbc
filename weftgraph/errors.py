"""Errors of the library."""


class GraphError(Exception):
    """Any graph failure."""


class SchemaError(GraphError):
    """A table is missing or has other columns or repeated keys."""


class EntityNotFoundError(GraphError):
    """The entity does not exist."""


class DocumentNotFoundError(GraphError):
    """The document does not exist."""


class DuplicateEntityError(GraphError):
    """The entity exists already."""


class InvalidNamespaceError(GraphError, ValueError):
    """The namespace has other characters than letters and digits."""


class ExtractionError(Exception):
    """Any extraction failure."""


class ConfigurationError(ExtractionError):
    """The extractor can't be set up."""


class PipelineError(Exception):
    """A run was stopped by its failure policy; ``statistics`` is its row."""

    def __init__(self, message: str, statistics: dict | None = None):
        super().__init__(message)
        self.statistics = statistics or {}


class ParseError(ExtractionError):
    """The response can't be read."""

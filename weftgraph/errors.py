"""Errors that statements raise."""


class QueryError(Exception):
    """A statement that can't be parsed or carried out."""


class NodeNotFound(QueryError):
    pass


class NodeExists(QueryError):
    pass


class SchemaError(QueryError):
    pass


class AggregationError(QueryError):
    pass


class CostThresholdExceeded(QueryError):
    pass


class BatchRollback(QueryError):
    pass


class VectorError(QueryError):
    pass


class VectorNotFound(VectorError):
    pass


class EmbedderRequired(VectorError):
    pass


class CeilingExceeded(QueryError):
    pass


class VersionMismatch(QueryError):
    pass


class StoreInUse(QueryError):
    pass

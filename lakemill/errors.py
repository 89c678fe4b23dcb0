"""Error classes of the engine."""


class EngineError(Exception):
    """Base of all."""


class SqlError(EngineError):
    """The text is not one statement of the dialect."""


class BindingError(EngineError):
    """Names or types do not fit."""


class PlanningError(EngineError):
    """A bound query cannot be planned."""


class StorageError(EngineError):
    """Paths, files or tables cannot be read."""


class ExecutionError(EngineError):
    """A running query failed."""


class ConfigurationError(EngineError):
    """A setting or connector is missing or wrong."""

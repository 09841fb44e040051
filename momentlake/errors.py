"""What can go wrong, by kind."""


class EngineError(Exception):
    """Any failure that the engine reports itself."""


class Unavailable(EngineError):
    """Something outside isn't there: a model, a store, a document."""


class ModelUnavailable(Unavailable):
    """A model can't be used as configured."""


class Moved(EngineError):
    """Another writer published a table meanwhile."""


class MissingArtifact(Unavailable):
    """A document that a step reads was never written."""


class Unsupported(EngineError):
    """A store doesn't offer what was asked of it."""


class UnknownOption(EngineError, ValueError):
    """A name that isn't one of the choices."""

    def __init__(self, what: str, given: object, choices) -> None:
        super().__init__(f"unknown {what} {given!r}; one of {', '.join(sorted(map(str, choices)))}")


class Refused(EngineError, ValueError):
    """A request that contradicts itself or the data."""

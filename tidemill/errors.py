"""Errors of the engine; their text starts with the kind."""


class EngineError(Exception):
    kind = "Error"

    def __init__(self, text: str) -> None:
        super().__init__(f"{self.kind}: {text}")


class InvalidArgument(EngineError, ValueError):
    """What the caller gave can't be used."""

    kind = "Invalid Argument Error"


class InvalidState(EngineError):
    """What is stored doesn't allow the operation."""

    kind = "Invalid State Error"


class Unimplemented(EngineError, NotImplementedError):
    """A known operation that this engine doesn't offer."""

    kind = "Unimplemented Error"

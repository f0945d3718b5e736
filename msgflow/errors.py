"""Errors of the engine, and the status code of each."""


class EngineError(Exception):
    code = "INTERNAL"


class NamespaceMismatch(EngineError):
    code = "PERMISSION_DENIED"


class NotFound(EngineError):
    code = "NOT_FOUND"


class InvalidRequest(EngineError):
    code = "INVALID_ARGUMENT"


class AlreadyExists(EngineError):
    code = "ALREADY_EXISTS"


class Overloaded(EngineError):
    code = "RESOURCE_EXHAUSTED"


class EmptyWords(EngineError):
    code = "FAILED_PRECONDITION"


class NotPending(EngineError):
    code = "ABORTED"


def status_code(error: BaseException) -> str:
    return getattr(error, "code", "INTERNAL") if isinstance(error, EngineError) else "INTERNAL"

"""Errors of the library; each has a stable code."""


class GraphError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def invalid(message: str) -> GraphError:
    return GraphError("INVALID_QUERY", message)

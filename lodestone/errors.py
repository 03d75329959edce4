"""Errors that the engine raises. Each has a code (2000 and up) and tells whether trying again can help."""

from __future__ import annotations


class EngineError(Exception):
    code = 2000
    recoverable = False


def kind(name: str, offset: int, recoverable: bool = False, base: type = EngineError, doc: str = "") -> type:
    return type(name, (base,), {"code": 2000 + offset, "recoverable": recoverable, "__doc__": doc or name})


ModelNotFound = kind("ModelNotFound", 0)
ModelLoadFailed = kind("ModelLoadFailed", 1)
TokenizationFailed = kind("TokenizationFailed", 100, True)
InputTooLong = kind("InputTooLong", 101, True)
InferenceFailed = kind("InferenceFailed", 200, True)
ProcessingTimeout = kind("ProcessingTimeout", 201, True)
BatchSizeExceeded = kind("BatchSizeExceeded", 202, True)
DimensionMismatch = kind("DimensionMismatch", 300)
InvalidInput = kind("InvalidInput", 301)
InvalidConfiguration = kind("InvalidConfiguration", 500)
StoreError = kind("StoreError", 700)
CacheError = kind("CacheError", 710)
QuantizationError = kind("QuantizationError", 720)
ProjectionError = kind("ProjectionError", 730)
RateLimited = kind("RateLimited", 740, True)

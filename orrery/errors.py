"""Errors that vector operators raise, all of them ValueErrors."""


class VectorError(ValueError):
    """Base of the errors here."""


class EmptyQuery(VectorError):
    pass


class DimensionMismatch(VectorError):
    def __init__(self, expected: int, found: int):
        super().__init__(f"vectors have {expected} dimensions, these have {found}")


class NonFinite(VectorError):
    pass


class DuplicateId(VectorError):
    pass


class NotNormalised(VectorError):
    pass


class TooFewVectors(VectorError):
    def __init__(self, wanted: int, found: int):
        super().__init__(f"{wanted} lists need as many different vectors, there are {found}")


class Unsupported(VectorError):
    pass

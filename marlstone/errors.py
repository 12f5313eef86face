"""Named errors of parsing, binding and execution."""


class SqlError(ValueError):
    """Base of all errors that a statement can raise before it runs."""


class ParseError(SqlError):
    pass


class RelationNotFound(SqlError):
    pass


class RelationExists(SqlError):
    pass


class AttributeNotFound(SqlError):
    pass


class DuplicateAttribute(SqlError):
    pass


class AmbiguousAttribute(SqlError):
    pass


class UnboundBinding(SqlError):
    pass


class DuplicateBinding(SqlError):
    pass


class UncomparableDataTypes(SqlError):
    pass


class Unimplemented(SqlError):
    pass


class CrossProduct(SqlError):
    """FROM lists relations that no equality connects."""


class MissingValues(SqlError):
    def __init__(self, columns: list[str]):
        super().__init__(f"no values for {', '.join(columns)}")
        self.columns = columns


class TooManyValues(SqlError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"{got} values for {expected} columns")
        self.expected, self.got = expected, got


class ConversionError(SqlError):
    def __init__(self, value, to):
        super().__init__(f"{value!r} as {to}")
        self.value, self.to = value, to


class TypeNotConvertible(ConversionError):
    pass


class ValueOverflow(ConversionError):
    pass


class TooLarge(ConversionError):
    pass


class DataTypeNotConvertible(SqlError):
    def __init__(self, column: int, cause: ConversionError):
        super().__init__(f"value {column}: {type(cause).__name__}: {cause}")
        self.column, self.cause = column, cause

"""Errors of the SQL layer."""


class SqlError(ValueError):
    """Base of all errors that a statement can raise before it runs."""


class NoStatement(SqlError):
    """The text holds no statement."""


class MultipleStatements(SqlError):
    """The text holds more than one statement."""


class Unsupported(SqlError):
    """A form of statement that the engine does not offer."""


class Unimplemented(SqlError):
    """A kind of statement that has no implementation."""


class UnexpectedStatement(SqlError):
    """A statement that makes no sense here, such as CREATE TABLE without columns."""


class SyntaxProblem(SqlError):
    """Text that can't be read."""


class NotFound(SqlError):
    """A database, schema, table or column that does not exist."""


class AlreadyExists(SqlError):
    """A database or table that exists already."""


class ConstraintViolation(SqlError):
    """A row that its table does not allow."""


class UniqueViolation(ConstraintViolation):
    """A key that a unique index has already."""

    def __init__(self, index: str, key: tuple):
        super().__init__(f"unique index {index} already has key {key}")
        self.index, self.key = index, key

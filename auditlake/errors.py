"""The two answers of a check that fails: the log is wrong, or it could not be checked."""


class LogDiverged(Exception):
    """What was read contradicts what was published or signed."""


class NotVerifiable(Exception):
    """Something needed for the check is missing."""

"""Exceptions raised on the driver."""


class AntiphonError(Exception):
    """Base of all of this library's errors."""


class DatasetError(AntiphonError):
    """A dataset is missing, empty or has the wrong columns."""


class ConfigurationError(AntiphonError):
    """A configuration cannot be read or holds invalid values."""


class InferenceLabelError(AntiphonError):
    """An inference label is none of neutral, entailment and contradiction."""


class NotPreparedError(AntiphonError):
    """A stage was used before its model was fitted or loaded."""

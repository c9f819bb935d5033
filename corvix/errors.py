"""Errors of the library."""


class CorvixError(Exception):
    """Base of all errors here."""


class ConfigError(CorvixError, ValueError):
    """A parameter or combination of parameters is not allowed."""


class DimensionMismatch(CorvixError, ValueError):
    """A vector doesn't have the number of components that its dataset has."""


class InvalidRecord(CorvixError, ValueError):
    """An input record can't be read."""


class ManifestError(CorvixError, ValueError):
    """A manifest breaks a rule."""


class ArtifactMissing(CorvixError, FileNotFoundError):
    """A file that a manifest names isn't there."""


class InvalidKey(CorvixError, ValueError):
    """A storage key or version name could leave its folder."""


class MergeError(CorvixError, ValueError):
    """Outputs of workers don't fit the plan."""


class BackendUnsupported(CorvixError, NotImplementedError):
    """A storage backend that isn't available."""

"""Errors: of the run's settings, of one input, and of an input without genes."""


class LociqError(Exception):
    """Ends the run of one input."""


class ConfigError(LociqError):
    """Ends the whole run, of a batch too."""


class NoGenesError(LociqError):
    """An input in which nothing was found; in a batch the others go on."""

    def __init__(self, step: str):
        super().__init__(f"{step} found no genes")


def is_fatal(error: Exception, batch: bool) -> bool:
    """Settings end everything; in a batch other errors end their input only."""
    return isinstance(error, ConfigError) or not isinstance(error, LociqError) or not batch

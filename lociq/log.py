"""Logging of a run: console, a file for each process, and the warnings for the summary."""

from __future__ import annotations

import logging
import os
import sys
import time

FORMAT = "%(asctime)s %(levelname)s:\t%(message)s"
DATES = "%Y-%m-%d %H:%M:%S"


class Warnings(logging.Handler):
    """Keeps what was warned of."""

    def __init__(self) -> None:
        super().__init__(logging.WARNING)
        self.messages: list[str] = []

    def emit(self, record: logging.LogRecord) -> None:
        self.messages.append(record.getMessage())


def timestamp(at: float | None = None, form: str = DATES) -> str:
    """Local time as the reports write it."""
    return time.strftime(form, time.localtime(at))


def set_up(folder: str | None = None, quiet: bool = False) -> Warnings:
    """Handlers of the run's logger; quiet leaves errors only on the console, the file holds all."""
    log = logging.getLogger("lociq")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    log.setLevel(logging.DEBUG)
    log.propagate = False
    console = logging.StreamHandler(sys.stderr)
    console.setLevel(logging.ERROR if quiet else logging.INFO)
    kept = Warnings()
    handlers: list[logging.Handler] = [console, kept]
    if folder:
        os.makedirs(folder, exist_ok=True)
        handlers.append(logging.FileHandler(os.path.join(folder, f"lociq_{os.getpid()}.log")))
    for h in handlers:
        h.setFormatter(logging.Formatter(FORMAT, DATES))
        log.addHandler(h)
    return kept

"""The last messages of the library, with their times, for a session that wants to show them."""

from __future__ import annotations

import logging
from collections import deque

NAME = "textquarry"
KEPT = 100


class Journal(logging.Handler):
    """Keeps the last ``KEPT`` messages of all levels; ``with`` takes it off again."""

    def __init__(self, kept: int = KEPT):
        super().__init__(logging.DEBUG)
        self.messages: deque[str] = deque(maxlen=kept)
        self.setFormatter(logging.Formatter("%(asctime)s.%(msecs)03d %(message)s", "%H:%M:%S"))

    def emit(self, record: logging.LogRecord) -> None:
        self.messages.append(self.format(record))

    def __enter__(self) -> Journal:
        log = logging.getLogger(NAME)
        self._before = log.level, log.propagate
        log.addHandler(self)
        log.setLevel(logging.DEBUG)
        return self

    def __exit__(self, *_) -> None:
        log = logging.getLogger(NAME)
        log.removeHandler(self)
        log.setLevel(self._before[0])

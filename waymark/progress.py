"""Progress as JSON lines."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

#: Fixed value: milliseconds between two messages at least.
DEBOUNCE = 200


class Progress:
    """Prints messages, none within DEBOUNCE of the one before; a stage is always printed, and so is the first message behind it."""

    def __init__(self, on: bool = True, write: Callable[[str], None] = print, clock: Callable[[], float] = lambda: time.time() * 1000):
        self.on, self.write, self.clock, self.last = on, write, clock, 0.0

    def message(self, text: str) -> None:
        if not self.on or self.last + DEBOUNCE > (now := self.clock()):
            return
        self.last = now
        self.write(json.dumps({"type": "PROGRESS", "message": text}))

    def stage(self, text: str) -> None:
        if self.on:
            self.last = 0.0
            self.write(json.dumps({"type": "PROGRESS_STAGE", "stage": text}))

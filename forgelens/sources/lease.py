"""One rate for the calls of all tasks together."""

from __future__ import annotations

import os
import random
import time
from collections.abc import Callable
from pathlib import Path


class Lease:
    """So many calls may begin in each window of time, wherever they are made.

    A call takes one of its window's files, which only one can create, in a folder that all executors share;
    where all are taken it waits for the next window. A task that ends or is slow leaves its part to the
    others. Windows go by the clock, so clocks that differ by d seconds let the calls of two windows
    overlap for d. Files of windows that are over are deleted by whoever begins a new one.
    """

    def __init__(self, folder: str, calls: int, seconds: float = 1.0, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time):
        if calls < 1 or seconds <= 0:
            raise ValueError("a window needs a length and a call")
        self.folder, self.calls, self.seconds, self.sleep, self.now = folder.removeprefix("file://"), calls, seconds, sleep, now

    def _taken(self, window: int) -> bool:
        at = Path(self.folder, str(window))
        at.mkdir(parents=True, exist_ok=True)
        first = random.randrange(self.calls)
        for k in range(self.calls):
            try:
                os.close(os.open(at / str((first + k) % self.calls), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            except FileExistsError:
                continue
            if not k:
                self._tidied(window)
            return True
        return False

    def _tidied(self, window: int) -> None:
        """Another may delete the same."""
        for old in Path(self.folder).iterdir():
            if old.name.isdigit() and int(old.name) < window - 1:
                for f in old.iterdir():
                    f.unlink(missing_ok=True)
                try:
                    old.rmdir()
                except OSError:
                    pass

    def take(self) -> None:
        """Returns when a call may begin."""
        while True:
            window = int(self.now() // self.seconds)
            if self._taken(window):
                return
            self.sleep(max(0.001, (window + 1) * self.seconds - self.now()))

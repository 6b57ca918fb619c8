"""Log set-up for notebooks and jobs."""

from __future__ import annotations

import logging
from logging.handlers import RotatingFileHandler


def set_up(path: str | None = None, level: int = logging.INFO, name: str = "granulo") -> logging.Logger:
    """A logger that writes to the console and, with a path, to a file that starts anew beyond 1 MB (three old ones stay).
    Calling it again replaces its handlers."""
    log = logging.getLogger(name)
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(RotatingFileHandler(path, maxBytes=1_000_000, backupCount=3, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(form)
        log.addHandler(h)
    log.setLevel(level)
    return log

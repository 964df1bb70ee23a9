"""Settings from defaults, an optional ``.env`` file and the environment, and logging to files.

A nested field is named with two underscores (``STORAGE__COMPACTION_MIN_TABLES``). Names
are not case-sensitive, unknown ones are ignored, and the environment goes before the file.
"""

from __future__ import annotations

import logging
import logging.handlers
import os
from collections.abc import Mapping
from pathlib import Path


# Names of the settings and what holds without them. A name's type is its default's.
DEFAULTS: dict[str, object] = {
    "data_dir": "data",
    "logging_level": "INFO",
    "logging_format": "standard",
    "hz": 8,
    "ingest__queue_max_frames": 10_000,
    "ingest__overflow_policy": "drop_newest",
    "ingest__batch_max_rows": 1_000,
    "ingest__batch_max_points": 50_000,
    "ingest__batch_max_ms": 50,
    "storage__flush_max_rows": 10_000,
    "storage__flush_max_points": 100_000,
    "storage__flush_max_bytes": 8 << 20,
    "storage__sstable_block_max_points": 256,
    "storage__compaction_min_tables": 4,
}
#: Values that are counts of at least so much.
LEAST = {"storage__compaction_min_tables": 2, "storage__sstable_block_max_points": 1, "hz": 1}


class Settings:
    """Settings as attributes, those of a group (``ingest``, ``storage``) without its prefix."""

    def __init__(self, values: Mapping[str, object]):
        self._values = {k: v for k, v in values.items() if "__" not in k}
        for group in sorted({k.split("__")[0] for k in values if "__" in k}):
            self._values[group] = Settings({k.split("__", 1)[1]: v for k, v in values.items() if k.startswith(group + "__")})

    def __getattr__(self, name: str):
        try:
            return self.__dict__["_values"][name]
        except KeyError:
            raise AttributeError(name) from None

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Settings) and self._values == other._values


def _typed(name: str, text: str) -> object:
    if not isinstance(DEFAULTS[name], int):
        return text
    value = int(text)
    if value < LEAST.get(name, value):
        raise ValueError(f"{name} must be at least {LEAST[name]}")
    return value


def read_env_file(path: str | Path) -> dict[str, str]:
    """``NAME=value`` lines; blank lines and those from ``#`` on are skipped, quotes around a value go."""
    out = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, is_set, value = line.strip().removeprefix("export ").partition("=")
            if is_set and not name.startswith("#"):
                value = value.strip()
                out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def load(environ: Mapping[str, str] | None = None, env_file: str | Path = ".env") -> Settings:
    """The settings in force."""
    given = {k.lower(): v for k, v in (read_env_file(env_file) | dict(os.environ if environ is None else environ)).items()}
    return Settings({name: _typed(name, given[name]) if name in given else default for name, default in DEFAULTS.items()})


# Line formats, size and number of log files.
FORMATS = {
    "standard": "%(levelname)s: %(asctime)s %(name)s - %(message)s",
    "detailed": "%(levelname)s: %(asctime)s %(name)s (%(filename)s:%(lineno)d) - %(message)s",
}
LOG_BYTES, LOG_BACKUPS = 5 << 20, 3


def set_up_logging(settings: Settings) -> Path:
    """Driver's log to the console, and to rotating ``debug.log`` and ``error.log``; returns their folder."""
    folder = Path(settings.data_dir) / "logs"
    folder.mkdir(parents=True, exist_ok=True)
    logger = logging.getLogger("flightlake")
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    logger.setLevel(logging.DEBUG)
    logger.propagate = False
    console = logging.StreamHandler()
    plans = [(console, settings.logging_level.upper(), settings.logging_format)]
    for name, level in (("debug.log", "DEBUG"), ("error.log", "ERROR")):
        plans.append((logging.handlers.RotatingFileHandler(folder / name, maxBytes=LOG_BYTES, backupCount=LOG_BACKUPS, encoding="utf-8"), level, "detailed"))
    for handler, level, form in plans:
        handler.setLevel(level)
        handler.setFormatter(logging.Formatter(FORMATS[form]))
        logger.addHandler(handler)
    return folder

"""Addresses and paths: mount rewriting, name checks, retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_mount(path: str, host: str, mount: str) -> str:
    """A host path below ``host`` as seen below ``mount``; addresses and other paths pass through."""
    if "://" in path:
        return path
    try:
        return str(PurePosixPath(mount) / PurePosixPath(path).relative_to(host))
    except ValueError:
        return path


def mount_path(path: Column, host: str, mount: str) -> Column:
    """As to_mount(), over a column."""
    inside = F.concat(F.lit(mount), F.substr(path, F.lit(len(host) + 1)))
    return F.when(F.contains(path, F.lit("://")), path).when(F.startswith(path, F.lit(host + "/")) | (path == host), inside).otherwise(path)


def first_answer(backends: Sequence[Callable[[], list]], tries: int = 3, delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """The first non-empty answer; each backend is tried ``tries`` times with waits that grow by ``delay``."""
    for backend in backends:
        for attempt in range(1, tries + 1):
            try:
                found = backend()
            except OSError:
                if attempt < tries:
                    sleep(delay * attempt)
                continue
            if found:
                return found
            break
    return []

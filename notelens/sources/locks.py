"""A lock file that names its owner; the lock of a process that is gone is taken over."""

from __future__ import annotations

import contextlib
import json
import os
import time
from collections.abc import Iterator

#: Seconds that an unreadable lock file is taken to be in the making.
GRACE = 5.0


class IndexLocked(RuntimeError):
    pass


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


def owner(path: str) -> int | None:
    try:
        with open(path, encoding="utf-8") as f:
            return int(json.load(f)["pid"])
    except (OSError, ValueError, KeyError, TypeError):
        return None


def held(path: str) -> bool:
    if not os.path.exists(path):
        return False
    pid = owner(path)
    if pid is not None:
        return _alive(pid)
    try:
        return time.time() - os.path.getmtime(path) < GRACE
    except OSError:
        return False


@contextlib.contextmanager
def file_lock(path: str) -> Iterator[None]:
    for _ in range(2):
        try:
            fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            if held(path):
                raise IndexLocked(f"{path} is held by process {owner(path)}") from None
            with contextlib.suppress(FileNotFoundError):
                os.unlink(path)
    else:
        raise IndexLocked(f"{path} was taken by another process")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump({"pid": os.getpid()}, f)
        yield
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(path)

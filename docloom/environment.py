"""Checks before a session begins its work."""

from __future__ import annotations

import os
import shutil


def checked(folders: list[str], programs: list[str] = ()) -> dict:
    """ok and errors: folders are made where missing and must be writable; programs must be on the path."""
    errors = [f"missing program: {p}" for p in programs if not shutil.which(p)]
    for f in folders:
        try:
            os.makedirs(f, exist_ok=True)
        except OSError as e:
            errors.append(f"can't make {f}: {e.strerror}")
            continue
        if not os.access(f, os.W_OK):
            errors.append(f"can't write to {f}")
    return {"ok": not errors, "errors": errors}

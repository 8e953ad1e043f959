"""Files of any store that Arrow knows."""

from __future__ import annotations

from pyarrow import fs


def open_file(path: str):
    """An open file from which blocks can be read and that can seek."""
    system, place = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_file(place)

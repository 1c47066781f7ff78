"""Files of the shared folder, read and written inside tasks.

Each task attempt writes a file of its own and moves it into place when it is complete; rows carry the path. A task that
is run again writes another file, and only the rows of one attempt survive, so a lost executor leaves no torn file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def open_read(uri: str):
    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


@contextmanager
def open_write(uri: str) -> Iterator:
    """A stream to ``uri``, which appears only when the block ends without an error."""
    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    part = f"{os.path.dirname(path)}/_{os.path.basename(path)}.part"
    with files.open_output_stream(part) as out:
        yield out
    files.move(part, path)


def attempt_name(suffix: str) -> str:
    """A file name that no other task attempt has."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.stageId()}-{task.taskAttemptId()}{suffix}"

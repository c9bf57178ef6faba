"""Files as a batch sink: tasks write beside the target, the driver moves whole files there once all tasks are done."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from .shared import file_system

#: Values that fill a hole at once.
FILL = 1 << 16


@dataclass
class Written(WriterCommitMessage):
    """(file beside the target, name) of every file of a task."""

    files: list[tuple[str, str]]


class CommittedFiles(DataSourceArrowWriter):
    """Rows (name, pos, v, content), sorted by name and pos, all rows of a name in one partition: ``v`` is written as the file's number ``pos``, holes before it as
    NaN. ``content`` is written as it is: at negative positions before the numbers, else after as many numbers as ``pos`` says, which ends the file. Two values for one position, or one
    beyond the end, raise ``ValueError``.

    A task writes into a folder of the write's own, under names of its attempt's own. Nothing is in the target before ``commit``; what tasks left that were
    lost or ran twice goes with that folder, as it does on ``abort``. With ``append`` a file that is there already raises ``FileExistsError`` and nothing is moved.
    """

    def __init__(self, folder: str, overwrite: bool, dtype: str = "f8"):
        self.folder, self.overwrite, self.dtype = folder.rstrip("/"), overwrite, dtype
        self.beside = f"{self.folder}/_writing-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: list[tuple[str, str]] = []
        system, at = file_system(self.beside)
        system.create_dir(at, recursive=True)
        out, name, place, ended, attempt = None, None, 0, False, uuid.uuid4().hex[:12]
        hole = np.full(FILL, np.nan, self.dtype).tobytes()
        size = np.dtype(self.dtype).itemsize
        try:
            for batch in iterator:
                names, contents = batch.column("name").to_pylist(), batch.column("content").to_pylist()
                values = batch.column("v").to_numpy(zero_copy_only=False).astype(self.dtype)
                positions = batch.column("pos").to_numpy()
                # Runs of numbers without a hole are written at once.
                cut = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1] or contents[k] is not None or contents[k - 1] is not None or positions[k] != positions[k - 1] + 1), len(names)]
                for x, y in zip(cut, cut[1:], strict=False):
                    if x == y:
                        continue
                    if names[x] != name:
                        if out:
                            out.close()
                        name, place, ended = names[x], 0, False
                        files.append((f"{self.beside}/{attempt}-{len(files)}", name))
                        out = system.open_output_stream(f"{at}/{attempt}-{len(files) - 1}")
                    missing = int(positions[x]) - place
                    if ended or missing < 0 <= positions[x]:
                        raise ValueError(f"two values for position {positions[x]} of {name}, or one beyond its end")
                    for k in range(0, missing, FILL):
                        out.write(hole[: size * min(FILL, missing - k)])
                    if contents[x] is not None:
                        out.write(contents[x])
                        ended = positions[x] >= 0
                    else:
                        out.write(values[x:y].tobytes())
                        place = int(positions[x]) + y - x
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        system, at = file_system(self.folder)
        taken = [n for _, n in files if system.get_file_info(f"{at}/{n}").type.name != "NotFound"]
        if taken and not self.overwrite:
            self._clear()
            raise FileExistsError(", ".join(sorted(taken)))
        for path, name in files:
            target = f"{at}/{name}"
            system.create_dir(target.rpartition("/")[0], recursive=True)
            try:
                system.move(file_system(path)[1], target)
            except OSError:
                system.delete_file(target)
                system.move(file_system(path)[1], target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, at = file_system(self.beside)
        if system.get_file_info(at).type.name != "NotFound":
            system.delete_dir(at)

"""Scripts of the user's run by task over rows: text on their input or a file as their argument, with a time limit; large outputs are stored and shown in part.

Only Python is run, by the interpreter of the task, and only source that the caller passes in; no query text becomes a command.
"""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import preview

TIMEOUT, OFFLOAD_BYTES = 30.0, 8192
SCHEMA = "id string, exit_code int, stdout string, stderr string, input_bytes long"


def _run(source: str, args: list[str], text: str, timeout: float) -> tuple[int | None, str, str]:
    """(exit code, stdout, stderr); the code is null of a script that was stopped."""
    try:
        done = subprocess.run([sys.executable, "-c", source, *args], input=text.encode(), capture_output=True, timeout=timeout)
        return done.returncode, done.stdout.decode("utf-8", "replace"), done.stderr.decode("utf-8", "replace")
    except subprocess.TimeoutExpired as stopped:
        return None, (stopped.stdout or b"").decode("utf-8", "replace"), f"stopped after {timeout:g} s"


def run_script(rows: DataFrame, source: str, as_file: bool = False, timeout: float = TIMEOUT) -> DataFrame:
    """(id, exit_code, stdout, stderr, input_bytes) of ``rows(id, content)``: the script gets the content on its input or, ``as_file``, as a file named by its argument. Null content is empty."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = content or ""
                if as_file:
                    # the file lives for one row, where the task is
                    with tempfile.TemporaryDirectory() as folder:
                        path = os.path.join(folder, "input")
                        with open(path, "w", encoding="utf-8") as file:
                            file.write(text)
                        found = _run(source, [path], "", timeout)
                else:
                    found = _run(source, [], text, timeout)
                out.append((key, *found, len(text.encode())))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return rows.select(F.col("id").cast("string").alias("id"), "content").mapInArrow(of, SCHEMA)


def offloaded(outputs: DataFrame, column: str, limit: int = OFFLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(outputs, blobs): outputs over the limit become a preview and the hash (ref) that the whole is stored under; the others stay, with no ref."""
    large = F.octet_length(column) > limit
    blobs = outputs.where(large).select(F.sha2(column, 256).alias("hash"), F.col(column).alias("content")).dropDuplicates(["hash"])
    return outputs.withColumns({"ref": F.when(large, F.sha2(column, 256)), column: preview(F.col(column), limit)}), blobs

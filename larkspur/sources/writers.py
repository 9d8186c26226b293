"""Writers of inventory rows, delimited files, reports, lines and failure folders."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_rows(items: DataFrame, path: str) -> None:
    items.write.mode("append").parquet(path)


def write_delimited(df: DataFrame, path: str, quoted: bool = True) -> None:
    """Semicolons, a header, quotes doubled."""
    df.write.mode("overwrite").option("sep", ";").option("header", True).option("quoteAll", quoted).option("escape", '"').csv(path)


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """Each part of a report as JSON lines in a folder of its name."""
    for name, part in parts.items():
        part.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def append_lines(lines: DataFrame, path: str) -> None:
    lines.select(F.col(lines.columns[0]).cast("string")).write.mode("append").text(path)


def write_failures(failures: DataFrame, path: str) -> None:
    """Failed rows in a folder for each class."""
    failures.write.mode("overwrite").partitionBy("failure").parquet(path)


def png(pixels: bytes, width: int, height: int) -> bytes:
    """A grey image as a PNG file."""
    import struct
    import zlib

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + pixels[k * width : (k + 1) * width] for k in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_templates(templates: DataFrame, folder: str) -> int:
    """Grey images (character, name, width, height, pixels) as PNG files in a folder for each character; returns how many.

    The folder is a URI that executors reach. A file takes its name once it is
    whole, so a task that is run again writes the same files. Characters that
    files can't be named by become ``_`` in names; a dash's folder is ``Dash``.
    Cap the rows with ``capped_per_class`` before.
    """

    def run(frames: Iterator) -> Iterator:
        import uuid

        import pandas as pd
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for r in frame.itertuples(index=False):
                where = f"{root}/{'Dash' if r.character == '-' else r.character}"
                name = re.sub(r'[\x00-\x1f"<>|:*?\\/]', "_", r.name)
                part = f"{where}/.{uuid.uuid4().hex}"
                files.create_dir(where, recursive=True)
                with files.open_output_stream(part) as out:
                    out.write(png(r.pixels, r.width, r.height))
                files.move(part, f"{where}/{name}.png")
            yield pd.DataFrame({"n": [len(frame)]})

    written = templates.select("character", "name", "width", "height", "pixels").mapInPandas(run, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

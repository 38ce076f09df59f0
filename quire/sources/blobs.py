"""Blobs by content: files below one folder of any file system that Arrow knows, named by their SHA-256."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

DIGEST = re.compile(r"[0-9a-f]{64}")


class BlobStore:
    """`folder` is a path or URI that driver and executors share."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _at(self) -> tuple[fs.FileSystem, str]:
        if self.folder.startswith("file:"):
            return fs.LocalFileSystem(), "/" + self.folder[5:].lstrip("/")
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def key_of(self, document: str) -> str:
        """The place of a document's content below the folder."""
        if not DIGEST.fullmatch(document or ""):
            raise ValueError("a document is named by a SHA-256 in small hexadecimal digits")
        return f"pdfs/{document[:2]}/{document}.pdf"

    def put(self, document: str, content: bytes) -> bool:
        """Keeps `content`; says whether it was there already. Others see a whole file or none."""
        system, root = self._at()
        path = f"{root}/{self.key_of(document)}"
        if system.get_file_info(path).type == fs.FileType.File:
            return True
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        fresh = f"{path}.{uuid.uuid4().hex}.new"
        with system.open_output_stream(fresh) as out:
            out.write(content)
        system.move(fresh, path)
        return False

    def put_all(self, files: DataFrame) -> DataFrame:
        """(id, existed) of files (id, content), written by the tasks that hold them; the result has to be used once."""
        store = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([store.put(i, c) for i, c in zip(ids, batch.column(1).to_pylist(), strict=True)], pa.bool_())], names=["id", "existed"])

        return files.where("id IS NOT NULL AND content IS NOT NULL").select("id", "content").mapInArrow(run, "id string, existed boolean")

    def get(self, document: str) -> bytes:
        system, root = self._at()
        with system.open_input_stream(f"{root}/{self.key_of(document)}") as source:
            return source.read()

    def exists(self, document: str) -> bool:
        system, root = self._at()
        return system.get_file_info(f"{root}/{self.key_of(document)}").type == fs.FileType.File

    def delete(self, document: str) -> bool:
        """Deletes a content and its folder if that is empty now; says whether it was there."""
        if not self.exists(document):
            return False
        system, root = self._at()
        path = f"{root}/{self.key_of(document)}"
        try:
            system.delete_file(path)
        except FileNotFoundError:
            return False
        folder = path.rsplit("/", 1)[0]
        try:
            if not system.get_file_info(fs.FileSelector(folder)):
                system.delete_dir(folder)
        except FileNotFoundError:
            pass  # another task was first
        return True

    def delete_all(self, documents: DataFrame) -> DataFrame:
        """(id, existed) of documents (id), deleted by tasks; the result has to be used once."""
        store = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([store.delete(i) for i in batch.column(0).to_pylist()], pa.bool_())], names=["id", "existed"])

        return documents.select("id").mapInArrow(run, "id string, existed boolean")

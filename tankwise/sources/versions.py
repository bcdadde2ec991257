"""Small versioned records in the shared folder.

A log is a folder of numbered JSON files.  A version is written aside and then
renamed into place without overwriting, so it is there whole or not at all and of
two writers of one number the second is told so.  The tables that a version names
are written before it and never changed after."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write ``path`` whole; False, and nothing changed, if it is there already."""
    fs, target = _fs(spark, path)
    _, aside = _fs(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(target),
                       spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:  # noqa: BLE001
        if fs.exists(target):
            fs.delete(aside, False)
            return False
        raise e
    return True


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of names, lengths and modification times of all files of a table."""
    fs, p = _fs(spark, path)
    digest = hashlib.sha256()
    found = []
    files = fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        name = f.getPath().toString()
        if not name.rsplit("/", 1)[-1].startswith((".", "_")):
            found.append((name, f.getLen(), f.getModificationTime()))
    for item in sorted(found):
        digest.update(repr(item).encode())
    return digest.hexdigest()[:32]


class Log:
    """Numbered versions under ``folder``, each a JSON object."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def numbers(self) -> list[int]:
        fs, p = _fs(self.spark, self.folder)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        return json.loads(read_text(self.spark, self._path(number)))

    def latest(self) -> tuple[int, dict | None]:
        """Number and record of the newest version; ``(-1, None)`` before the first."""
        n = self.numbers()
        return (n[-1], self.read(n[-1])) if n else (-1, None)

    def commit(self, number: int, record: dict) -> bool:
        """Add version ``number``; False if somebody else has added it."""
        return write_text_once(self.spark, self._path(number), json.dumps(record, sort_keys=True))

    def add(self, record: dict) -> int:
        """Add ``record`` as the next version, after whatever came in between."""
        while True:
            number = self.latest()[0] + 1
            if self.commit(number, record):
                return number

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where it is unset a temporary folder will do on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _local_dirs.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="marlstone-"))
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass

    atexit.register(drop)
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Spark then deletes the shuffle files of a write once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends here, and a lost executor costs no earlier stage."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the files of a table from ``materialize`` that nothing reads any more."""
    delete(df.sparkSession, df.written_to)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class _Known(dict):
    """xxh3 of words, kept for the first ``most`` of them."""

    def __init__(self, most: int) -> None:
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value


class Words:
    """64-bit xxh3 hashes of the words of texts; those met early are hashed once."""

    def __init__(self, most: int = 1 << 17) -> None:
        self.known = _Known(most)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def of_texts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, one text after the other, and the number of words of each."""
        found = [self.hashes(t.split() if t else []) for t in texts]
        return np.concatenate(found) if found else np.empty(0, np.uint64), np.array([len(x) for x in found], np.int64)


class Rolling:
    """Hashes of all runs of n items: a polynomial modulo 2**64 with an odd base, from running sums and inverse powers.

    Equal runs have equal hashes. Runs of few hashed words (n-grams, shingles) keep nearly
    all 64 bits; long runs in which two items alternate as in a Thue-Morse word lose many,
    so what must be exact for those is told by the items or a digest of them.
    """

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(m, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def __call__(self, items: np.ndarray, n: int) -> np.ndarray:
        m = len(items) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        self._grow(len(items))
        sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * self.up[: len(items)], out=sums[1:])
        return (sums[n:] - sums[:-n]) * self.down[:m]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in a run of ``width`` from one of ``starts``."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:n]) > 0

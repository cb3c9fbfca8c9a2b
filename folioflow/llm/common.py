"""What the operators share: checkpoints, Arrow maps, word and hash kernels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: The white space that separates words: space and the code points 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only if it was counted and has at most so many bytes, 8 for each value; beyond it a shuffled join runs.
BROADCAST_BYTES = 16_000_000
#: Option of cut() for a column keys of random numbers, in which a dictionary finds nothing.
RANDOM_KEYS = {"parquet.enable.dictionary#keys.list.element": "false"}
#: How cut() runs its query: shuffle files go when it ends, rather than when the driver's collector finds their handles unused, and the batches
#: that go to Python and back are small, as they are held outside the heap, several times over.
_RUN = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
}
_RULES = "spark.sql.optimizer.excludedRules"
#: Settings of cut() for a grouping of rows that were dealt out and sorted by its key: one pass over the sorted rows, no table of groups.
#: The sort has to be kept for that: Spark takes it away before a grouping, as it doesn't change the result.
SORTED_GROUPS = {"spark.sql.execution.replaceHashWithSortAgg": "true", _RULES: "org.apache.spark.sql.catalyst.optimizer.EliminateSorts"}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir; in a temporary one only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(where)
    folder = f"{sc.getCheckpointDir()}/tables"
    files, path = _files(spark, folder)
    files.deleteOnExit(path)
    return folder


def _files(spark: SparkSession, at: str):
    """The file system of a path, and the path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def cut(df: DataFrame, settings: dict[str, str] | None = None, **options: str) -> DataFrame:
    """The rows, computed once: a Parquet table in the shared folder, which goes with forget() or when the application ends. options: the writer's.
    settings hold for this query only; rules to leave out are added to those that the session leaves out.

    A table rather than checkpoint(): it is compressed, read by column, and carries no constraints of the plan that made it, which double
    with each round of an iteration.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    run = _RUN | (settings or {})
    before = {k: spark.conf.get(k, None) for k in run}
    if _RULES in run and before[_RULES]:
        run[_RULES] = f"{before[_RULES]},{run[_RULES]}"
    for k, v in run.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more."""
    for df in tables:
        files, path = _files(df.sparkSession, df.cut_at)
        files.delete(path, True)


def lookup(df: DataFrame, rows: int, cells: int = 0) -> DataFrame:
    """df, marked for broadcast if its counted rows, of numbers, and the cells in their arrays are few."""
    return F.broadcast(df) if 8 * (rows * len(df.columns) + cells) <= BROADCAST_BYTES else df


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to differ from all that are taken."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def of_groups(rows: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """rows joined with groups: key, size (its number of rows) and what the rows get.

    No group meets in one task beyond its share: if the groups are too many to broadcast, those with over a hundred-thousandth of all rows
    (at most 100,000) are broadcast, and the others are shuffled.
    """
    n, total = groups.agg(F.count(F.lit(1)), F.sum("size")).first()
    if 8 * n * len(groups.columns) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups.drop("size")), key)
    large, rest = groups.where(F.col("size") > total // 100_000).drop("size"), groups.where(F.col("size") <= total // 100_000).drop("size")
    return rows.join(F.broadcast(large), key).unionByName(rows.join(F.broadcast(large.select(key)), key, "left_anti").join(rest, key))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased. bytes.split() separates at exactly the white space of WORD_PATTERN."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str, carry: list[str]) -> DataFrame:
    """mapInArrow by bounded slices of a batch. f(slice) returns the new columns by name; carry names the input columns that stay."""
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = f(part)
                cols = {c: part.column(part.schema.names.index(c)) for c in carry} | out
                arrays = [cols[x.name].cast(x.type) if isinstance(cols[x.name], (pa.Array, pa.ChunkedArray)) else pa.array(cols[x.name], x.type) for x in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)
            # workers live on between tasks; what they don't need goes back
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 2000, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most so many rows or bytes of text (one row at least)."""
    texts = [x for x in batch.columns if pa.types.is_string(x.type) or pa.types.is_large_string(x.type)]
    if not texts:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
        return
    lengths = sum(np.nan_to_num(pc.binary_length(x).to_numpy(zero_copy_only=False).astype(float)) for x in texts).tolist()
    start = held = 0
    for k, n in enumerate(lengths):
        if k > start and (held + n > size or k - start >= rows):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.names.index(name)).to_pylist()


#: Words that a worker remembers at most.
CACHED = 150_000
_WORDS: dict[bytes, int] = {}


def word_codes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; a bounded cache holds those of frequent words."""
    cache = _WORDS
    if len(cache) > CACHED:
        cache.clear()
    h = xxhash.xxh3_64_intdigest
    out = []
    for w in words:
        c = cache.get(w)
        if c is None:
            c = h(w)
            if len(w) < 64:
                cache[w] = c
        out.append(c)
    return np.array(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, by the multipliers of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_GRAM = seeded(11, 64) | np.uint64(1)


def distinct(codes: np.ndarray) -> np.ndarray:
    """Sorted distinct codes; codes is sorted in place. np.unique takes twice the time for small sets."""
    codes.sort()
    new = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    return codes[new]


def shingle_codes(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit codes of the shingles of so many words; of fewer words, the whole sequence is the only one."""
    if not words:
        return np.empty(0, np.uint64)
    codes = word_codes(words)
    w = min(width, len(codes))
    with np.errstate(over="ignore"):
        n = len(codes) - w + 1
        total = np.full(n, w, np.uint64)
        for k in range(w):
            total += codes[k : k + n] * _GRAM[k]
    return distinct(mixed(total))

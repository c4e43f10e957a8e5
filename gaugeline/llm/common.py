"""What several corpus operators share: shared checkpoints, row keys, word hashes, samples."""

from __future__ import annotations

import gc
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.shared import shared_folder

#: Runs of letters and of numerals that are no decimal digits (superscripts, fractions, Roman ones).
LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """The runs of letters of a text."""
    found = LETTERS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return ["".join(run) for w in found for alpha, run in itertools.groupby(w, str.isalpha) if alpha]


def letter_spans(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of letters of a text."""
    for m in LETTERS.finditer(text):
        if m[0].isalpha():
            yield m.span()
            continue
        at = m.start()
        for alpha, run in itertools.groupby(m[0], str.isalpha):
            n = len(list(run))
            if alpha:
                yield at, at + n
            at += n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A setting of Spark's: a query's shuffle files are deleted as soon as it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def hold(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that all executors share.

    What was shuffled for it is not needed again, so it is deleted at once."""
    spark = df.sparkSession
    sc, before = spark.sparkContext, spark.conf.get(CLEAN_UP, None)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(spark))
    spark.conf.set(CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint()  # a frame takes the setting when it is made
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def release(spark: SparkSession) -> None:
    """Have shuffle files of results that are held by now deleted; else they stay until the driver's JVM
    happens to collect its garbage, and count on top of the next shuffle."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(columns: list[str], name: str) -> str:
    """The name, or the name with underscores after it, that no column has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(n: int, column: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def few_of_each(rows: DataFrame, each: int) -> DataFrame:
    """At most `each` rows of an id, lowest in a hash order of their texts; map tasks keep no more of them."""
    in_turn = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    return rows.withColumn("_nth", F.row_number().over(in_turn)).where(F.col("_nth") <= each).drop("_nth")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int, each: int = 4) -> DataFrame:
    """At most `bound` labelled ids, lowest in a fixed hash order, with their texts, `each` of an id that repeats.

    A document labelled more than once takes its largest label; null and other labels are left out.
    The ids are bounded by `bound`, so they may be broadcast; the rows by bound x each.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    return few_of_each(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), each)


_in_use: dict[str, Callable[[], object]] = {}


def using(name: str, clear: Callable[[], object]) -> None:
    """Says whose words a Python worker keeps. A worker serves one stage after another; when another
    operator's turn comes, what was kept for the one before is emptied."""
    if name not in _in_use:
        for empty in _in_use.values():
            empty()
        _in_use.clear()
        _in_use[name] = clear


class WordHashes(dict):
    """Word -> 64-bit xxh3, kept up to `most` words; the same in every process."""

    most = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One per Python worker.
HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One order-sensitive 64-bit hash of aligned columns of 64-bit values."""
    h = np.full_like(parts[0], 0x9E3779B97F4A7C15)
    for p in parts:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + p)
    return h


@dataclass(frozen=True)
class Words:
    """The words of a batch of texts: `tokens` are the distinct ones, `at` the number of every word in
    order, and text i has those from first[i] to first[i + 1]."""

    tokens: list[str]
    at: np.ndarray
    first: np.ndarray

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For every text the sum of one value a word."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        return total[self.first[1:]] - total[self.first[:-1]]


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words are runs of anything but U+0020 and U+0009 to U+000D; `lower` turns A-Z small. Null texts have none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    tokens, at, first = coded.dictionary.to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy()
    if "" in tokens:  # white space at an end of a text
        keep = at != tokens.index("")
        at, first = at[keep], np.concatenate([[0], np.cumsum(keep)])[first]
    return Words(tokens, at, first)


def slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most_bytes` of text, one row at least, so that memory follows no row count."""
    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_numpy(zero_copy_only=False).astype(float)) + 64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes)))
        yield batch.slice(at, to - at)
        at = to


def mapped(f: Callable[[pa.RecordBatch], list], schema: pa.Schema):
    """A mapInArrow function from parts of batches with a text column to the schema's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = [x if isinstance(x, pa.Array) else pa.array(x) for x in f(part)]
                yield pa.RecordBatch.from_arrays([x.cast(t.type) for x, t in zip(out, schema, strict=True)], schema=schema)

    return run


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in rows that come sorted by them; a run is whole even across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in key]
        keys = list(zip(*columns, strict=True))
        at = 0
        for i in range(len(keys) + 1):
            if i == len(keys) or keys[i] != (keys[at] if i > at else last):
                if i > at:
                    if last is not None and keys[at] != last:
                        yield last, pa.Table.from_batches(held)
                        held = []
                    held.append(batch.slice(at, i - at))
                    last = keys[at]
                at = i
    if held:
        yield last, pa.Table.from_batches(held)

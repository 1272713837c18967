"""Grep by an index of trigrams.

The index has for each run of three characters, folded by case, the chunks that hold it, sorted
by the run. What a match must hold is read off the pattern: a literal all of its trigrams, a
sequence what its parts need, alternatives what one of them needs, a repeated part what it needs if it
stands once at least. Anything else needs nothing. Chunks whose trigrams meet that are candidates; only these are
read, and the pattern itself decides. So results are those of a scan of all chunks, whatever the pattern.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import lexical

#: Dotted and dotless i match each other's capitals in the JVM; here they are one letter.
_I_FORMS, _I = "İı", "II"


def folded(text: Column | str) -> Column:
    return F.translate(tx.vfold(text), _I_FORMS, _I)


def folded_of(text: str) -> str:
    return tx.vfold_of(text).translate(str.maketrans(_I_FORMS, _I))


@dataclass(frozen=True)
class Needs:
    """Runs that a match must hold: all of ``grams``, all of ``parts``, one of each of ``choices``. Empty: nothing is known."""

    grams: frozenset[str] = frozenset()
    choices: tuple[tuple[Needs, ...], ...] = ()

    def __bool__(self) -> bool:
        return bool(self.grams or self.choices)

    def __and__(self, other: Needs) -> Needs:
        return Needs(self.grams | other.grams, self.choices + other.choices)

    def all_grams(self) -> set[str]:
        return set(self.grams).union(*(x.all_grams() for own in self.choices for x in own))

    def test(self, held: Column) -> Column:
        """Whether a chunk's set of runs, by their keys, meets it."""
        parts = [F.array_contains(held, key_of(g)) for g in sorted(self.grams)]
        parts += [reduce(lambda a, b: a | b, [x.test(held) for x in own]) for own in self.choices]
        return reduce(lambda a, b: a & b, parts)


def literal_needs(literal: str) -> Needs:
    own = folded_of(literal)
    return Needs(frozenset(own[k : k + 3] for k in range(len(own) - 2)))


def pattern_needs(pattern: str) -> Needs:
    """What a match of a regular expression needs; nothing where the expression can't be read."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return Needs()
    return _sequence_needs(tree)


def _sequence_needs(tree: Iterable) -> Needs:
    found, run = Needs(), ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        found, run = found & literal_needs(run), ""
        if name == "BRANCH":
            options = tuple(_sequence_needs(x) for x in arg[1])
            if all(options):
                found &= Needs(choices=(options,))
        elif name == "SUBPATTERN":
            found &= _sequence_needs(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            found &= _sequence_needs(arg[2])
        elif name == "ATOMIC_GROUP":
            found &= _sequence_needs(arg)
    return found & literal_needs(run)


#: Chunks whose runs are gathered at once.
AT_ONCE = 1000
#: Tasks that share the rows of one run.
SPREAD = 16


def key_of(gram: str) -> int:
    """Three characters of 21 bits each as one number."""
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of some texts with the ids of those that hold it."""
    for batch in batches:
        for low in range(0, batch.num_rows, AT_ONCE):
            yield _runs_of(batch.slice(low, AT_ONCE))


def _runs_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, n = batch.column(1).to_pylist(), batch.num_rows
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(n), [len(t) for t in texts])
    within = row[2:] == row[:-2]
    keys = pa.array((letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:])[within]).dictionary_encode()
    held = np.unique(keys.indices.to_numpy().astype(np.int64) * n + row[2:][within])
    code = held // n
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    ids = pa.ListArray.from_arrays(pa.array(np.r_[first, len(code)], pa.int32()), batch.column(0).take(pa.array(held % n)))
    return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(code[first])), ids], ["gram", "ids"])


@dataclass(frozen=True)
class GramIndex:
    """``gram`` (see ``key_of``) and ``ids`` of all chunks, stored at a place. A run has a row for each thousand chunks or so."""

    spark: SparkSession
    place: str

    @staticmethod
    def written(chunks: DataFrame, place: str) -> GramIndex:
        own = chunks.where("content is not null").select("id", folded("content").alias("text")).mapInArrow(_runs, "gram long, ids array<long>")
        # A run that all chunks hold is dealt to several tasks; ranges would make the runs twice, to sample them.
        own.repartition("gram", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(SPREAD))).sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{place}/grams")
        return GramIndex(chunks.sparkSession, place)

    @staticmethod
    def opened(chunks: DataFrame, place: str) -> GramIndex:
        """The index at the place if one has been written whole, else a new one."""
        spark = chunks.sparkSession
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/grams/_SUCCESS")
        return GramIndex(spark, place) if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done) else GramIndex.written(chunks, place)

    def candidates(self, needs: Needs) -> DataFrame:
        """``id`` of chunks that may match. A chunk's set is at most as large as the pattern's."""
        rows = self.spark.read.parquet(f"{self.place}/grams").where(F.col("gram").isin(sorted(map(key_of, needs.all_grams()))))
        return rows.select("gram", F.explode("ids").alias("id")).groupBy("id").agg(F.collect_set("gram").alias("held")).where(needs.test(F.col("held"))).select("id")

    def chunks_for(self, chunks: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
        """The chunks that may match; all of them where the pattern needs no run of three characters."""
        needs = pattern_needs(pattern) if regex else literal_needs(pattern)
        return chunks.join(self.candidates(needs), "id", "left_semi") if needs else chunks

    def grep(self, chunks: DataFrame, pattern: str, regex: bool = False, limit: int | None = None, context: int = 120) -> DataFrame:
        """As ``lexical.grep``, but over all chunks for regular expressions too; all matches where no limit is given."""
        return lexical.matched(self.chunks_for(chunks, pattern, regex), pattern, regex, limit, context)

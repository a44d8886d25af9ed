"""O-06 with versions: vocabulary, statistics and dictionary that grow by deltas.

A book is a folder. Adding clauses writes one more ``version=N`` below each of its
tables and, last, the version's row of the manifest; a version without that row does
not exist, and the next addition writes over what it left. Nothing of earlier
versions is written again, and any version can be read later.

Every table holds partial results that merge:

* ``vocabulary``: multiplicity (sum), first and last column (min, max) per term;
* ``sums``: sum of n, of n^2 and of n by label per term, for the cells that a version
  adds: its own clauses with all terms, and **earlier clauses with the terms that are
  new**, since containment looks inside words. The earlier clauses
  are stored and meet only the new terms;
* ``units``: clauses and labels counted (sum);
* ``clauses``: the clauses, as the second point needs them;
* ``words``: a clause's counted words, which make the dictionary;
* ``dictionary``: words the version brings, with **stable ids**: they follow the ids of
  the versions before, by frequency inside their own version. A word keeps its id,
  so models and encoded clauses of earlier versions stay valid.

One writer at a time; clauses are expected to be new (keys not in the book).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators.encode import FIRST_WORD_ID, dictionary
from clausewise.operators.vocab import containment_sums, counted_words, vocabulary


class Book:
    """``keys``: two BIGINT columns that order the clauses; ``labels``: 0/1 columns."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], labels: Sequence[str]):
        self.spark, self.root, self.keys, self.labels = spark, root.rstrip("/"), list(keys), list(labels)

    def _path(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/version={version}"

    def _write(self, df: DataFrame, table: str, version: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(table, version))
        return self.spark.read.schema(df.schema).parquet(self._path(table, version))

    def manifest(self) -> DataFrame | None:
        """``version, n_units, n_words`` of every version, None for an empty book."""
        try:
            return self.spark.read.parquet(f"{self.root}/manifest")
        except AnalysisException:
            return None

    def version(self) -> int:
        m = self.manifest()
        return 0 if m is None else m.agg(F.max("version")).first()[0] or 0

    def _parts(self, table: str, version: int | None) -> DataFrame:
        """The table's partial rows of all versions up to ``version`` (none: the latest)."""
        last = self.version() if version is None else version
        if not 1 <= last <= self.version():
            raise ValueError(f"the book has no version {last}")
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(
            *[self._path(table, v) for v in range(1, last + 1)]).drop("version")

    # --- reading ----------------------------------------------------------------

    def vocabulary(self, version: int | None = None) -> DataFrame:
        """``term, multiplicity, first_.., last_..`` as ``operators.vocab.vocabulary``."""
        pos = [*self.keys, "pos"]
        first, last = (F.struct(*[F.col(f"{side}_{c}").alias(c) for c in pos]) for side in ("first", "last"))
        merged = self._parts("vocabulary", version).groupBy("term").agg(
            F.sum("multiplicity").alias("multiplicity"), F.min(first).alias("f"), F.max(last).alias("l"))
        return merged.select("term", "multiplicity", *[F.col(f"f.{c}").alias(f"first_{c}") for c in pos],
                             *[F.col(f"l.{c}").alias(f"last_{c}") for c in pos])

    def sums(self, version: int | None = None) -> DataFrame:
        """``term, total, q, s1_<label>..`` as ``operators.stats.label_sums``."""
        cols = ["total", "q", *[f"s1_{x}" for x in self.labels]]
        return self._parts("sums", version).groupBy("term").agg(*[F.sum(c).alias(c) for c in cols])

    def sizes(self, version: int | None = None) -> DataFrame:
        """One row: ``n_units`` and the number of 1s of each label."""
        return self._parts("units", version).agg(*[F.sum(c).cast("long").alias(c) for c in ("n_units", *self.labels)])

    def dictionary(self, version: int | None = None) -> DataFrame:
        """``term, id``."""
        return self._parts("dictionary", version)

    # --- adding -----------------------------------------------------------------

    def add(self, units: DataFrame) -> int:
        """Adds clauses (keys, ``tokens``, labels) and returns the new version."""
        old, new = self.version(), self.version() + 1
        units = self._write(units.select(*self.keys, "tokens", *self.labels), "clauses", new)
        vocab = self._write(vocabulary(units, [], self.keys), "vocabulary", new)
        words = self._write(counted_words(units, [*self.keys, *self.labels]), "words", new)
        terms = vocab.select("term")
        if old:
            known = self._write(self.vocabulary(old).select("term"), "known-terms", new)
            fresh = self._write(terms.join(known, "term", "left_anti"), "new-terms", new)
            mine = containment_sums(units, known.unionByName(fresh), [], self.keys, self.labels)
            earlier = containment_sums(self._parts("clauses", old), fresh, [], self.keys, self.labels)
            both = mine.unionByName(earlier.select(*mine.columns))
            sums = both.groupBy("term").agg(*[F.sum(c).alias(c) for c in mine.columns[1:]])
        else:
            sums = containment_sums(units, terms, [], self.keys, self.labels, vocab_from_same_tokens=True)
        self._write(sums, "sums", new)
        counts = self._write(units.agg(F.count(F.lit(1)).cast("long").alias("n_units"),
                                       *[F.sum(F.col(x).cast("long")).alias(x) for x in self.labels]), "units", new)

        rows = words.groupBy(F.lower("word").alias("word")).agg(F.sum("k").alias("k"))
        before = 0
        if old:
            before = self.manifest().agg(F.sum("n_words")).first()[0]
            rows = rows.join(self.dictionary(old).select("term"), F.col("word") == F.col("term"), "left_anti")
        born = dictionary(rows, count_col="k", store=lambda df, name: self._write(df, name, new))
        ids = self._write(born.select("term", (F.col("id") + F.lit(int(before))).cast("int").alias("id")), "dictionary", new)
        # the manifest's row makes the version exist
        done = counts.select(F.lit(new).alias("version"), "n_units", F.lit(ids.count()).cast("long").alias("n_words"))
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/part={new}")
        return new

    def next_id(self) -> int:
        m = self.manifest()
        return FIRST_WORD_ID + (0 if m is None else int(m.agg(F.sum("n_words")).first()[0] or 0))

"""The index as a versioned store: commits that add rows and remove documents, and the counts retrieval needs.

A commit writes its rows by bucket of documents into folders of its own, the documents it removes, and what both
change in each bucket's term counts and sizes. Then one small manifest file, created only if no other commit took its number,
makes it a version. Nothing is rewritten: a reader takes the folders its version lists and leaves out rows of documents that a later
commit removed. Term frequencies and corpus sizes are sums of the stored changes, never recounted.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import release
from corpusmill.operators.lexical import LexicalIndex, with_idf
from corpusmill.operators.maintenance import dedup_chunks
from corpusmill.operators.scale import NARROW_ROWS, small_side, stage
from corpusmill.sources.index_store import BUCKETS

COUNTS = "doc_bucket int, term string, df bigint"
SIZES = "doc_bucket int, chunks bigint, tokens bigint"
REMOVED = "doc_id {kind}, doc_bucket int"


class VersionedIndex:
    """Tables under ``path``, each keyed by doc_id; ``postings`` are index rows with n_tokens and terms.

    ``bucket_by`` names another column for tables that are looked up by it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, bucket_by: dict[str, str] | None = None):
        self.spark, self.path, self.buckets, self.bucket_by = spark, path, buckets, bucket_by or {}

    # ---- the manifest ------------------------------------------------------

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _named(self, version: int):
        where, fs = self._files()
        return self.spark._jvm.org.apache.hadoop.fs.Path(where, f"{version:08d}.json"), fs

    def versions(self) -> list[int]:
        """Numbers of all versions, in order."""
        where, fs = self._files()
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of; the newest whole one unless named. A store without versions is empty."""
        for number in [version] if version is not None else reversed(self.versions()):
            file, fs = self._named(number)
            stream = fs.open(file)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return json.loads(text)
            except json.JSONDecodeError:  # being written, or its writer was lost: the version before it holds
                if version is not None:
                    raise
        return {"version": 0, "commits": [], "schemas": {}}

    def _publish(self, manifest: dict) -> None:
        file, fs = self._named(manifest["version"])
        # Fails if another commit has this number.
        stream = fs.create(file, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()

    # ---- writing -----------------------------------------------------------

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def commit(
        self, added: dict[str, DataFrame | list[DataFrame]], removed: DataFrame | None = None, batch: str | None = None, fresh: bool = False, instead: bool = False
    ) -> int:
        """Adds rows and removes the documents ``removed`` (doc_id) of earlier versions, in one step; returns the version.

        A document that is removed and added is replaced. A ``batch`` that some version has already isn't
        committed again. ``fresh`` starts from nothing, as a compaction does; ``instead`` puts the tables of ``added`` in
        the place of what is stored of them, and leaves the others. Rows that come as several tables are written one after another.
        """
        now = self.manifest()
        if batch is not None and any(c.get("batch") == batch for c in now["commits"]):
            return now["version"]
        name = f"{now['version'] + 1:08d}-{uuid.uuid4().hex[:12]}"
        schemas = dict(now["schemas"])
        earlier = now["commits"]
        if instead:
            recounted = {"counted": False} if "postings" in added else {}
            earlier = [c | {"tables": [t for t in c["tables"] if t not in added]} | recounted for c in earlier]
        for table, rows in added.items():
            for some in rows if isinstance(rows, list) else [rows]:
                schemas[table] = some.schema.jsonValue()
                placed = some.withColumn("doc_bucket", self._bucket(self.bucket_by.get(table, "doc_id")))
                placed.write.mode("append").option("compression", "zstd").partitionBy("doc_bucket").parquet(f"{self.path}/{table}/commit={name}")
        entry: dict = {"name": name, "tables": sorted(added), "removed": None, "batch": batch}
        changed = None
        if removed is not None:
            gone = stage(removed.select("doc_id").distinct().withColumn("doc_bucket", self._bucket("doc_id")), "removed")
            gone.write.parquet(f"{self.path}/_removed/commit={name}")
            entry["removed"] = gone.schema["doc_id"].dataType.simpleString()
            if "postings" in now["schemas"] and not fresh:
                touched = [r["doc_bucket"] for r in gone.select("doc_bucket").distinct().collect()]
                old = self.tables(["postings"], buckets=touched)["postings"].join(small_side(gone.select("doc_id"), NARROW_ROWS), "doc_id", "left_semi")
                changed = old.select("doc_id", "n_tokens", "terms", F.lit(-1).alias("sign"))
        if "postings" in added:
            new = self.spark.read.schema(self._stored_schema(schemas, "postings")).parquet(f"{self.path}/postings/commit={name}")
            new = new.select("doc_id", "n_tokens", "terms", F.lit(1).alias("sign"))
            changed = new if changed is None else changed.unionByName(new)
        if changed is not None:
            changed = changed.withColumn("doc_bucket", self._bucket("doc_id"))
            words = changed.select("doc_bucket", "sign", F.explode("terms.term").alias("term"))
            counts = words.groupBy("doc_bucket", "term").agg(F.sum("sign").alias("df")).where("df <> 0")
            sizes = changed.groupBy("doc_bucket").agg(F.sum("sign").alias("chunks"), F.sum(F.col("sign") * F.col("n_tokens")).alias("tokens"))
            counts.write.option("compression", "zstd").parquet(f"{self.path}/_counts/commit={name}")
            sizes.write.parquet(f"{self.path}/_sizes/commit={name}")
            entry["counted"] = True
        commits = [entry] if fresh else [*earlier, entry]
        self._publish({"version": now["version"] + 1, "commits": commits, "schemas": schemas})
        return now["version"] + 1

    def purge(self, doc_ids: DataFrame) -> int:
        """Removes documents from every table: chunks, parents, postings, vectors and the rest."""
        return self.commit({}, doc_ids)

    def replace(self, docs: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]]) -> int:
        """Builds documents anew from what they are now, in the place of what is stored of them."""
        return self.commit(build(docs), docs.select("doc_id"))

    def rebuild(self, docs: DataFrame, sources: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]]) -> DataFrame:
        """Replaces ``docs`` from ``sources`` (doc_id, text): (total, success, failed).

        A document whose source is missing or empty has failed and stays as it is stored.
        """
        read = stage(docs.drop("text").join(sources.select("doc_id", "text"), "doc_id", "left"), "rebuild")
        there = F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0
        self.replace(read.where(there), build)
        return read.agg(F.count("*").alias("total"), F.count_if(there).alias("success"), F.count_if(~there).alias("failed"))

    def compact(self) -> int:
        """The live rows of all tables as one commit without removals, for shorter reads."""
        live = self.tables()
        return self.commit({name: stage(table, name) for name, table in live.items()}, fresh=True)

    # ---- reading -----------------------------------------------------------

    def _stored_schema(self, schemas: dict, table: str) -> T.StructType:
        fields = T.StructType.fromJson(schemas[table]).fields
        return T.StructType([*fields, T.StructField("doc_bucket", T.IntegerType()), T.StructField("commit", T.StringType())])

    def tables(self, names: list[str] | None = None, version: int | None = None, buckets: list[int] | None = None) -> dict[str, DataFrame]:
        """Live rows of the tables of a version, of some buckets only if named."""
        now = self.manifest(version)
        number = lambda column: F.substring(column, 1, 8).cast("int")
        kinds = [c for c in now["commits"] if c["removed"]]
        gone = None
        if kinds:
            paths = [f"{self.path}/_removed/commit={c['name']}" for c in kinds]
            schema = REMOVED.format(kind=kinds[0]["removed"]) + ", commit string"
            rows = self.spark.read.option("basePath", f"{self.path}/_removed").schema(schema).parquet(*paths)
            if buckets is not None and not set(names or now["schemas"]) & set(self.bucket_by):
                rows = rows.where(F.col("doc_bucket").isin(buckets))
            gone = small_side(rows.groupBy("doc_id").agg(F.max(number(F.col("commit"))).alias("_gone")), NARROW_ROWS)
        out = {}
        for name in names or sorted(now["schemas"]):
            held = [c for c in now["commits"] if name in c["tables"]]
            schema = self._stored_schema(now["schemas"], name)
            if not held:
                out[name] = self.spark.createDataFrame([], schema).drop("doc_bucket", "commit")
                continue
            rows = self.spark.read.option("basePath", f"{self.path}/{name}").schema(schema)
            rows = rows.parquet(*[f"{self.path}/{name}/commit={c['name']}" for c in held])
            if buckets is not None:
                rows = rows.where(F.col("doc_bucket").isin(buckets))
            if gone is not None:
                rows = rows.join(gone, "doc_id", "left").where(F.col("_gone").isNull() | (number(F.col("commit")) >= F.col("_gone")))
            out[name] = rows.select(*[f.name for f in schema.fields[:-2]])
        return out

    def _sums(self, name: str, schema: str, version: int | None) -> DataFrame:
        held = [c for c in self.manifest(version)["commits"] if c.get("counted")]
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/commit={c['name']}" for c in held])

    def lexical(self, version: int | None = None) -> LexicalIndex:
        """The lexical index of a version, its frequencies and sizes from the stored counts."""
        frequency = self._sums("_counts", COUNTS, version).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        sizes = self._sums("_sizes", SIZES, version).agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n_chunks"), F.sum("tokens").alias("tokens"))
        terms, stats = with_idf(frequency, sizes.select("n_chunks", F.try_divide("tokens", "n_chunks").alias("avg_tokens")))
        return LexicalIndex(self.tables(["postings"], version)["postings"], terms, stats)


def drop_copies(store: VersionedIndex) -> int:
    """Takes the copies of chunks inside a document (``maintenance.dedup_chunks``) out of every table that is keyed by chunk, in one version.

    Only documents that have copies are written anew; what else is stored of them stays. Where they are most of the store,
    the tables that are keyed by chunk are written as a whole instead, so that no reader looks for documents that were removed.
    Tables meet one row for each document and 64 chunks, some buckets at a time, so that they aren't shuffled.
    """
    release(store.spark)
    live = store.tables()
    chunks = live["chunks"] if "page" in live["chunks"].columns else live["chunks"].withColumn("page", F.lit(None).cast("int"))
    kept = stage(dedup_chunks(chunks).select("doc_id", "chunk_index", "copies"), "kept-chunks")
    touched = stage(kept.where("copies > 1").select("doc_id").distinct().withColumn("doc_bucket", store._bucket("doc_id")), "touched")
    stays = kept.join(small_side(touched.select("doc_id"), NARROW_ROWS), "doc_id", "left_semi")
    block, bit = F.expr("shiftright(cast(chunk_index AS bigint), 6)"), F.expr("shiftleft(1L, cast(chunk_index & 63 AS int))")
    bits = stays.groupBy("doc_id", block.alias("_block")).agg(F.bit_or(bit).alias("_bits")).withColumn("doc_bucket", store._bucket("doc_id"))
    bits = stage(bits, "kept-bits")
    whole = 2 * stays.count() > kept.count()
    passes = min(store.buckets, max(1, math.ceil(bits.count() / (NARROW_ROWS // 2))))
    added: dict[str, DataFrame | list[DataFrame]] = {}
    for name, table in live.items():
        keyed = "chunk_index" in table.columns
        if whole and not keyed:
            continue
        added[name] = []
        shares = 1 if name in store.bucket_by else passes
        for share in range(shares):
            buckets = list(range(share, store.buckets, shares))
            here = lambda rows: rows.where(F.col("doc_bucket").isin(buckets)).drop("doc_bucket")  # noqa: B023, E731
            rows = table if shares == 1 else store.tables([name], buckets=buckets)[name]
            mine = small_side(here(touched), NARROW_ROWS)
            if whole:
                rows = rows.join(mine.withColumn("_touched", F.lit(True)), "doc_id", "left")
            else:
                rows = rows.join(mine, "doc_id", "left_semi").withColumn("_touched", F.lit(True))
            if keyed:
                rows = rows.withColumn("_block", block).join(small_side(here(bits), NARROW_ROWS), ["doc_id", "_block"], "left")
                rows = rows.where(F.col("_touched").isNull() | F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)))
            added[name].append(rows.select(table.columns))
    version = store.commit(added, None if whole else touched, instead=whole)
    release(store.spark)
    return version

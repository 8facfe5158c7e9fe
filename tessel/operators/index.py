"""The incremental chunk index: reuse of vectors by hash, whole-item replacement, pruning, manifests and their state.

Tables are immutable: a change writes the scopes that it touches as new files and then commits a list of files, so readers
see whole items, a failed write leaves the version before, and what was not touched is not written again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import word_windows
from tessel.tables import saved, shared_dir

#: How chunks are cut, as part of a signature.
CHUNKER = "wordwindow-v1"


def chunk_items(items: DataFrame, size: int = 512, overlap: int = 64, context=None) -> DataFrame:
    """(source_type, source_id, item_id, content, meta) -> chunks with content_hash and embed_hash, which covers the
    situating context when there is one."""
    context = context if context is not None else F.lit("")
    base = items.select("source_type", "source_id", "item_id", "meta", F.posexplode(word_windows("content", size, overlap)).alias("chunk_index", "content")).withColumn("context", context)
    embedded = F.when(F.col("context") != "", F.concat("context", F.lit("\n"), "content")).otherwise(F.col("content"))
    return base.withColumns({"id": F.concat_ws(":", "source_type", "source_id", "item_id", "chunk_index"), "content_hash": F.sha1("content"), "embed_hash": F.sha1(embedded)})


def cached_vectors(stored: DataFrame, model: str) -> DataFrame:
    """(embed_hash, embedding): one vector for each hash, that of the smallest id."""
    have = stored.where((F.col("model") == model) & (F.size("embedding") > 0) & (F.col("embed_hash") != ""))
    return have.groupBy("embed_hash").agg(F.min_by("embedding", "id").alias("embedding"))


#: Hashes that are broadcast to a store, when counted; of more both sides are shuffled.
BROADCAST_HASHES = 200_000


def with_vectors(chunks: DataFrame, stored: DataFrame, embed, model: str) -> DataFrame:
    """Chunks with embedding, model and reused: stored vectors by hash, the others from embed(DataFrame of embed_hash,
    content) -> (embed_hash, embedding), asked once for each distinct hash. A vector that fails stays null.

    Of the store only rows with a hash of these chunks are grouped, and they are written once, for what is reused and for what is
    missing; where the hashes are few the store is not shuffled at all."""
    folder = shared_dir(chunks.sparkSession)
    wanted = saved(chunks.select("embed_hash").distinct(), folder, "wanted")
    have = stored.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_HASHES else wanted, "embed_hash", "left_semi")
    known = saved(cached_vectors(have, model), folder, "known")
    found = chunks.join(known, "embed_hash", "left")
    missing = chunks.join(known, "embed_hash", "left_anti").groupBy("embed_hash").agg(F.min("content").alias("content"))
    fresh = embed(missing).select("embed_hash", F.col("embedding").alias("__fresh"))
    out = found.withColumn("reused", F.col("embedding").isNotNull()).join(fresh, "embed_hash", "left")
    return out.withColumn("embedding", F.coalesce("embedding", "__fresh")).withColumn("model", F.lit(model)).drop("__fresh")


_SCOPE = ["source_type", "source_id", "item_id"]


def replace_items(stored: DataFrame, items: DataFrame, chunks: DataFrame) -> DataFrame:
    """stored without the items, and their new chunks: items that chunk to nothing are cleared."""
    return stored.join(items.select(*_SCOPE).distinct(), _SCOPE, "left_anti").unionByName(chunks.select(*stored.columns))


def completeness(chunks: DataFrame) -> DataFrame:
    """(scope, chunks, failed, complete) of each item: complete if every chunk has its vector."""
    own = chunks.groupBy(*_SCOPE).agg(F.count("*").alias("chunks"), F.count_if(F.col("embedding").isNull()).alias("failed"))
    return own.withColumn("complete", F.col("failed") == 0)


def prune(stored: DataFrame, source_type: str, source_id: str, keep: DataFrame) -> DataFrame:
    """The scope keeps only items of keep (item_id); an empty keep clears it; other scopes stay."""
    inside = (F.col("source_type") == source_type) & (F.col("source_id") == source_id)
    kept = stored.where(inside).join(keep.select("item_id").distinct(), "item_id", "left_semi")
    return stored.where(~inside).unionByName(kept.select(*stored.columns))


def delete_source(stored: DataFrame, source_id: str) -> DataFrame:
    return stored.where(F.col("source_id") != source_id)


def count_scope(stored: DataFrame) -> DataFrame:
    return stored.groupBy("source_type", "source_id").agg(F.count("*").alias("n"))


def list_items(stored: DataFrame) -> DataFrame:
    return stored.groupBy(*_SCOPE).agg(F.count("*").alias("chunks"))


def ordered_hashes(stored: DataFrame) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("chunk_index", "content_hash")))
    return stored.groupBy(*_SCOPE).agg(F.transform(own, lambda x: x["content_hash"]).alias("hashes"))


def signature(model: str, size: int = 512, overlap: int = 64, chunker: str = CHUNKER) -> str:
    """What a compiled item was made with: another model, chunker or window makes everything stale."""
    return json.dumps({"embedding_model": model, "chunker": chunker, "chunk_size": size, "chunk_overlap": overlap}, sort_keys=True)


def fingerprint() -> Column:
    return F.sha1(F.coalesce("content", F.lit("")))


def manifest(items: DataFrame, done: DataFrame, made_with: str) -> DataFrame:
    """Fingerprints of the items that are complete: (scope, fingerprint, signature, chunks)."""
    prints = items.select(*_SCOPE, fingerprint().alias("fingerprint"), F.lit(made_with).alias("signature"))
    return prints.join(done.where("complete").select(*_SCOPE, "chunks"), _SCOPE)


def unchanged(items: DataFrame, old: DataFrame, stored: DataFrame, made_with: str) -> DataFrame:
    """Items with the fingerprint and the signature of the manifest, and rows in the store."""
    prints = items.withColumn("fingerprint", fingerprint())
    same = prints.join(old.where(F.col("signature") == made_with).select(*_SCOPE, "fingerprint"), [*_SCOPE, "fingerprint"], "left_semi")
    return same.join(stored.select(*_SCOPE).distinct(), _SCOPE, "left_semi").drop("fingerprint")


def state(items: DataFrame, old: DataFrame, made_with: str, stored: DataFrame | None = None) -> DataFrame:
    """One row for each source: state (none, stale, compiled) with how many items are added, removed, changed, and known with
    another signature; and how many chunks the store has, if it is given. A source whose store is empty is stale."""
    a = items.select(*_SCOPE, fingerprint().alias("now"))
    b = old.select(*_SCOPE, F.col("fingerprint").alias("then"), (F.col("signature") != made_with).alias("other"))
    both = a.join(b, _SCOPE, "full_outer").groupBy("source_type", "source_id").agg(
        F.count_if(F.col("then").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("removed"), F.count_if(F.col("now") != F.col("then")).alias("changed"),
        F.count_if("other").alias("resigned"), F.count("then").alias("known"), F.count("now").alias("there"),
    )
    if stored is not None:
        both = both.join(count_scope(stored).withColumnRenamed("n", "chunks"), ["source_type", "source_id"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    stale = F.col("added") + F.col("removed") + F.col("changed") + F.col("resigned") > 0
    if stored is not None:
        stale = stale | ((F.col("chunks") == 0) & (F.col("there") > 0))
    return both.withColumn("state", F.when(F.col("known") == 0, "none").when(stale, "stale").otherwise("compiled")).drop("known", "there")


def compile_items(items: DataFrame, stored: DataFrame, old: DataFrame, embed, model: str, size: int = 512, overlap: int = 64) -> tuple[DataFrame, DataFrame]:
    """(next store, next manifest): unchanged items are skipped, changed ones upserted, vanished ones pruned.

    The new chunks are written once and read for both, so the model is asked once and both tell of the same vectors."""
    made_with = signature(model, size, overlap)
    same = unchanged(items, old, stored, made_with)
    todo = items.join(same.select(*_SCOPE), _SCOPE, "left_anti")
    chunks = saved(with_vectors(chunk_items(todo, size, overlap), stored, embed, model), shared_dir(items.sparkSession), "chunks")
    current = stored.join(items.select(*_SCOPE).distinct(), _SCOPE, "left_semi")
    kept = old.join(same.select(*_SCOPE), _SCOPE, "left_semi")
    return replace_items(current, todo, chunks), kept.unionByName(manifest(todo, completeness(chunks), made_with))


def verified_copy(source: DataFrame, copy: DataFrame) -> DataFrame:
    """(scope, source, copy, ok): chunks of each scope in a store and in its copy; a copy is good if all are ok."""
    a, b = (count_scope(t).withColumnRenamed("n", name) for t, name in ((source, "source"), (copy, "copy")))
    both = a.join(b, ["source_type", "source_id"], "full_outer").fillna(0, ["source", "copy"])
    return both.withColumn("ok", F.col("source") == F.col("copy"))


def status(stored: DataFrame) -> DataFrame:
    """(model, dims, rows, embedded): what the store holds by model and width of its vectors."""
    dims = F.when(F.size("embedding") > 0, F.size("embedding"))
    return stored.groupBy("model", dims.alias("dims")).agg(F.count("*").alias("rows"), F.count(dims).alias("embedded"))


def manifest_key(kind: Column, source: Column, backend: Column) -> Column:
    """kind:id@backend; without a backend kind:id, which is how manifests of one store are named."""
    return F.concat(kind, F.lit(":"), source, F.when(F.coalesce(backend, F.lit("")) != "", F.concat(F.lit("@"), backend)).otherwise(F.lit("")))


def forget(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries (key, ...) without those of the sources (kind, id), under whatever backend: the key is a source's own, or its own with one more
    @ and a name behind it. An id may hold an @ itself."""
    gone = sources.select(F.concat("kind", F.lit(":"), F.col("id").cast("string")).alias("__gone")).distinct()
    named = entries.withColumn("__gone", F.regexp_replace("key", "@[^@]*$", ""))
    kept = named.join(gone, "__gone", "left_anti").drop("__gone")
    return kept.join(gone, F.col("key") == F.col("__gone"), "left_anti")


class ChunkStore:
    """A table in a folder, in buckets by scope. A version is a small file that lists the folder of each bucket; the highest
    is current. Data files are never changed: a write adds the buckets that it touches and then names the next version, which
    fails if another writer was faster."""

    def __init__(self, spark, path: str, buckets: int = 64, scope: tuple[str, ...] = ("source_type", "source_id")) -> None:
        self.spark, self.path, self.buckets, self.scope = spark, path.rstrip("/"), buckets, scope
        self.at = self._path(f"{self.path}/versions")
        self.fs = self.at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """The highest version; 0 for none."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at)] if self.fs.exists(self.at) else []
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def _folders(self, version: int) -> dict[int, str]:
        if not version:
            return {}
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/versions/v{version}").first()
        return {int(k): v for k, v in json.loads(rows.value)["buckets"].items()}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.scope), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: dict[int, str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/data/{f}/__bucket={k}" for k, f in sorted(folders.items())]) if folders else None

    def read(self) -> DataFrame | None:
        return self._rows(self._folders(self.version()))

    def _commit(self, version: int, folders: dict[int, str]) -> int:
        """The list is written aside and takes its name whole, in one rename that fails if the name is there: a reader sees it all or
        not, and a writer that dies leaves the version before."""
        aside, jvm = self._path(f"{self.path}/versions/.{version}-{uuid.uuid4().hex}"), self.spark._jvm
        out = self.fs.create(aside, False)
        out.write(json.dumps({"buckets": folders}).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(self.at).toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(aside), self.fs.makeQualified(self._path(f"{self.path}/versions/v{version}")), never)
        except Exception:
            self.fs.delete(aside, False)
            raise
        return version

    def _written(self, df: DataFrame) -> dict[int, str]:
        """Writes rows by bucket as new files; the buckets that have rows. A bucket with very many rows has many files."""
        name = uuid.uuid4().hex
        dealt = df.withColumn("__bucket", self._bucket())
        dealt.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{name}")
        at = self._path(f"{self.path}/data/{name}")
        return {int(s.getPath().getName().split("=")[1]): name for s in self.fs.listStatus(at) if s.getPath().getName().startswith("__bucket=")}

    def write(self, df: DataFrame) -> int:
        """The whole table anew."""
        version = self.version()
        return self._commit(version + 1, self._written(df))

    def replace(self, scopes: DataFrame, rows: DataFrame) -> int:
        """The rows of some scopes anew, which is none for those that `rows` has nothing of; only their buckets are written."""
        version = self.version()
        folders = self._folders(version)
        touched = {r.b for r in scopes.select(self._bucket().alias("b")).distinct().collect()}  # no more than there are buckets
        old = self._rows({k: f for k, f in folders.items() if k in touched})
        if old is not None:
            rows = old.join(scopes.select(*self.scope).distinct(), list(self.scope), "left_anti").select(*old.columns).unionByName(rows.select(*old.columns))
        return self._commit(version + 1, {k: f for k, f in folders.items() if k not in touched} | self._written(rows))

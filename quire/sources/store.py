"""The store: relations as parquet in buckets of documents, replaced bucket by bucket, and the catalogue's life cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import base_name
from quire.operators.lexical import term_bucket
from quire.schemas import RELATIONS, SCHEMA_VERSION
from quire.session import checkpointed
from quire.sources.blobs import BlobStore

#: Relations that hang off a document, by the column that names it.
OWNED = {"document_names": "document_id", "pages": "document_id", "blocks": "document_id", "chunks": "document_id", "entity_mentions": "document_id", "vectors": "document_id", "text_sizes": "document_id"}
#: What else says in which bucket a relation's rows lie; the text index lies by term.
PLACED = {"pdf_documents": "id", "chunk_spans": "chunk_id", "dead_chunks": "chunk_id", "postings": "term"}
BUCKETS, BUCKET = 64, "_bucket"
SEARCHABLE = ("indexed_lexical", "ready")


class Store:
    """Tables of a folder of any Hadoop file system, in a folder per bucket.

    Rows are added as files. Where rows are replaced, the buckets that hold them are written anew and put in place of the
    old ones when all are complete; other buckets are not touched. One writer at a time is assumed; a reader whose bucket
    is replaced meanwhile has to read again.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, str(folder).rstrip("/"), buckets
        self.blobs = BlobStore(self.folder)
        jvm = spark._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path())
        if int(self._text("schema_version") or 0) > SCHEMA_VERSION:
            raise ValueError("the store is of a newer version")
        self._keep("schema_version", str(SCHEMA_VERSION))
        kept = self._text("buckets")
        self.buckets = int(kept) if kept else buckets  # rows that are there lie by it
        self._keep("buckets", str(self.buckets))

    def _text(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        source = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def _keep(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{name}.schema"))

    def _schema(self, name: str) -> T.StructType:
        if self.exists(name):
            import json

            return T.StructType.fromJson(json.loads(self._text(f"{name}.schema")))
        if name in RELATIONS:
            return RELATIONS[name]
        raise KeyError(name)

    def stored(self, name: str) -> DataFrame:
        """The table with its bucket; an empty one of its schema if nothing is there."""
        schema = T.StructType([*self._schema(name).fields, T.StructField(BUCKET, T.IntegerType())])
        if not self._fs.exists(self._path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")

    def read(self, name: str) -> DataFrame:
        """The table; an empty one of its schema if nothing is there."""
        return self.stored(name).drop(BUCKET)

    def _placed(self, name: str, df: DataFrame) -> DataFrame:
        column = F.col(OWNED.get(name) or PLACED[name])
        return df.withColumn(BUCKET, term_bucket(column, self.buckets))

    def _write(self, name: str, df: DataFrame, mode: str) -> None:
        """Adds rows, or puts them in place of the buckets that they are of."""
        schema = self._schema(name) if self.exists(name) or name in RELATIONS else df.schema
        if not self.exists(name):
            self._keep(f"{name}.schema", schema.json())
        fields = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
        # rows of a bucket come together, so that a bucket has few files
        placed = self._placed(name, df.select(*fields)).repartition(BUCKET)
        placed.write.partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic").mode(mode).parquet(f"{self.folder}/{name}")

    def append(self, name: str, df: DataFrame) -> None:
        self._write(name, df, "append")

    def swap(self, name: str, keys: DataFrame, column: str, rows: DataFrame | None = None) -> None:
        """Takes out the rows whose `column` is in `keys`, and adds `rows`. Only buckets of either are written."""
        if not self.exists(name):
            if rows is not None:
                self.append(name, rows)
            return
        out = self.stored(name).join(keys.select(column).distinct(), column, "left_semi").select(BUCKET)
        touched = {r[0] for r in out.distinct().collect()}  # buckets are few
        if rows is not None:
            touched |= {r[0] for r in self._placed(name, rows).select(BUCKET).distinct().collect()}
        if not touched:
            return
        kept = self.stored(name).where(F.col(BUCKET).isin(sorted(touched))).join(keys.select(column).distinct(), column, "left_anti").drop(BUCKET)
        new = checkpointed(kept if rows is None else kept.unionByName(rows, allowMissingColumns=True))
        self._write(name, new, "overwrite")
        left = {r[0] for r in self._placed(name, new).select(BUCKET).distinct().collect()}
        for bucket in touched - left:
            self._fs.delete(self._path(name, f"{BUCKET}={bucket}"), True)

    def clear(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    # ------------------------------------------------------------------------------------------ catalogue

    def insert_if_absent(self, name: str, rows: DataFrame, key: str = "id") -> None:
        self.append(name, checkpointed(rows.dropDuplicates([key]).join(self.read(name).select(key), key, "left_anti")))

    def record_uploads(self, files: DataFrame) -> None:
        """New contents enter the catalogue as `stored`; every upload's name enters the log, in any case."""
        good = files.where("error IS NULL").withColumn("name", base_name(F.col("original_filename")))
        now = F.current_timestamp()
        documents = good.select("id", "storage_key", "media_type", "size_bytes", F.lit("stored").alias("status"), F.lit(None).cast("string").alias("error_message"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("string").alias("embedding_model"), F.lit(None).cast("string").alias("chunker_version"), F.lit("pending").alias("metadata_status"), F.lit(None).cast("string").alias("metadata_model"), F.lit(None).cast("string").alias("metadata_error"))
        names = good.where("name IS NOT NULL").select("id", "name", now.alias("uploaded_at"))
        last = self.read("document_names").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        # ids rise within and across batches; they need not be dense
        numbered = names.select((F.monotonically_increasing_id() + last + 1).alias("id"), F.col("id").alias("document_id"), F.col("name").alias("original_filename"), "uploaded_at")
        self.append("document_names", numbered)
        self.insert_if_absent("pdf_documents", documents)

    def replace_document(self, name: str, rows: DataFrame, documents: DataFrame) -> None:
        """`rows` in place of all that the table holds for `documents` (id)."""
        self.swap(name, documents.select(F.col("id").alias(OWNED[name])), OWNED[name], rows)

    def set_status(self, changes: DataFrame) -> None:
        """Changes (id, and any of status, error_message, embedding_model, chunker_version, metadata_status,
        metadata_model, metadata_error); null keeps what is there but clears error columns. Unknown ids raise."""
        known = self.read("pdf_documents")
        if not changes.join(known.select("id"), "id", "left_anti").isEmpty():
            raise KeyError("no such document")
        new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in changes.columns if c != "id"], F.lit(True).alias("_changed"))
        joined = known.join(new, "id")
        clearing = {"error_message", "metadata_error"}
        columns = []
        for c in known.columns:
            if c == "updated_at":
                columns.append(F.when(F.col("_changed"), F.current_timestamp()).otherwise(F.col(c)).alias(c))
            elif f"_{c}" in new.columns:
                columns.append((F.when(F.col("_changed"), F.col(f"_{c}")).otherwise(F.col(c)) if c in clearing else F.coalesce(f"_{c}", c)).alias(c))
            else:
                columns.append(F.col(c))
        self.swap("pdf_documents", changes.select("id"), "id", checkpointed(joined.select(*columns)))

    def delete(self, ids: list[str] | DataFrame | None = None) -> int:
        """Deletes documents (ids, or a table of id), all of them if none are named, with their contents and everything
        that hangs off them; says how many."""
        known = self.read("pdf_documents").select("id")
        if isinstance(ids, list):
            ids = self.spark.createDataFrame([(i,) for i in ids], "id string")
        gone = checkpointed(known if ids is None else known.join(ids.select("id"), "id", "left_semi"))
        count = gone.count()
        if not count:
            return 0
        if ids is None:
            for name in (*OWNED, *PLACED):
                self.clear(name)
        else:
            owned = gone.select(F.col("id").alias("document_id"))
            self.bury(owned)
            chunks = checkpointed(self.read("chunks").join(owned, "document_id", "left_semi").select(F.col("id").alias("chunk_id")))
            self.swap("chunk_spans", chunks, "chunk_id")
            for name, column in OWNED.items():
                self.swap(name, owned, column)
            self.swap("pdf_documents", gone, "id")
        self.blobs.delete_all(gone).count()
        return count

    # ------------------------------------------------------------------------------------------ text index

    def bury(self, documents: DataFrame) -> None:
        """Takes the chunks of `documents` (document_id) out of searches; the index itself is not written."""
        if self.exists("postings"):
            dead = self.read("chunks").join(documents, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
            self.append("dead_chunks", checkpointed(dead.join(self.read("dead_chunks"), "chunk_id", "left_anti")))

    def index_chunks(self, rows: DataFrame) -> None:
        """Adds index rows (term, chunk_id, document_id, tf, len) of new chunks. Chunks that were buried are dug out again."""
        ids = checkpointed(rows.select("chunk_id").distinct())
        buried = checkpointed(self.read("dead_chunks").join(ids, "chunk_id", "left_semi"))
        self.append("postings", rows.join(buried, "chunk_id", "left_anti"))
        self.swap("dead_chunks", buried, "chunk_id")

    def live_postings(self) -> DataFrame:
        """The index with its bucket, without buried chunks."""
        return self.stored("postings").join(self.read("dead_chunks"), "chunk_id", "left_anti")

    def compact_index(self) -> None:
        """Writes the index without buried chunks."""
        live = checkpointed(self.live_postings().drop(BUCKET))
        self.clear("postings")
        self.append("postings", live)
        self.clear("dead_chunks")

    def drop_stale_vectors(self, active: str) -> list[str]:
        """Drops vectors of other models than `active`, by fingerprint; says which, sorted."""
        if not self.exists("vectors"):
            return []
        stale = self.read("vectors").where(F.col("model_fingerprint") != active)
        names = sorted(r[0] for r in stale.select("model_fingerprint").distinct().collect())
        self.swap("vectors", checkpointed(stale.select("document_id", "model_fingerprint").distinct()).select("model_fingerprint"), "model_fingerprint")
        return names

    def reset_vectors(self) -> None:
        """Empties the collection of vectors; documents that had some are searched by text until they are encoded again."""
        ready = self.read("pdf_documents").where("status = 'ready' AND embedding_model IS NOT NULL").select("id")
        self.clear("vectors")
        if not ready.isEmpty():
            self.set_status(checkpointed(ready.select("id", F.lit("indexed_lexical").alias("status"))))

    def write_report(self, name: str, df: DataFrame, overwrite: bool = False) -> None:
        """A JSON report; one that is there already is refused unless `overwrite`."""
        df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").json(f"{self.folder}/reports/{name}")


def latest_names(names: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, name): each document's last uploaded name, by log id, or its id."""
    last = names.groupBy(F.col("document_id").alias("id")).agg(F.max_by("original_filename", "id").alias("n"))
    return documents.select("id").join(last, "id", "left").select("id", F.coalesce("n", "id").alias("name"))

"""Documents that keep arriving: chunked, embedded and merged into an index that can be searched after each batch.

An index has a register of its documents beside it: each one's place, a digest of its text and the number of its chunks.
A batch is merged whole: its rows replace what an earlier try of it has left, so a batch that runs again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import providers
from ..operators import long_documents
from ..plans import pipelines
from ..sources import readers, sinks
from ..sources.scratch import scratch, stored

REGISTER = "source_path string, doc_pos long, year int, month int, digest string, chunks long, dim int"


def line_stream(spark: SparkSession, root: str, years: list[int] | None = None) -> DataFrame:
    """source_path (still a URI), file_bytes, block, line of *.txt files that arrive below root: a file is read by as many
    tasks as it has splits. Files whose path has none of the years in it aren't read; readers.dated_pieces() looks closer."""
    files = spark.readStream.format("text").option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    meta = F.col("_metadata")
    return readers.of_years(files, years).select(meta["file_path"].alias("source_path"), meta["file_size"].alias("file_bytes"), meta["file_block_start"].alias("block"), F.col("value").alias("line"))


def register(spark: SparkSession, index_dir: str, before: int | None = None) -> DataFrame:
    """The register's latest row of each document, from batches before a certain one."""
    path = f"{index_dir}/documents"
    if not sinks.exists(spark, path):
        return spark.createDataFrame([], REGISTER + ", batch long")
    rows = spark.read.schema(REGISTER + ", batch long").parquet(path)
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    return rows.groupBy("source_path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "source_path"]), "batch").alias("r")).select("source_path", "r.*")


def merge_batch(docs: DataFrame, batch: int, config: dict, provider) -> None:
    """A batch's documents (source_path, year, month, text) into the index: new ones after those that are there, in order of
    their paths. A blank one is an error.

    A document that comes again keeps its place: unchanged it is left alone, changed its old chunks go. Only the index's
    partitions (year, month, batch) that held such chunks are written again.
    """
    merge_pieces(long_documents.pieces(long_documents.lines_of(docs)), batch, config, provider)


def merge_pieces(pieces: DataFrame, batch: int, config: dict, provider, blank: bool = True) -> None:
    """merge_batch() of documents in pieces, with or without the blank ones."""
    spark, root = pieces.sparkSession, config["index_dir"]
    if sinks.exists(spark, f"{root}/index") and "batch" not in spark.read.parquet(f"{root}/index").columns:
        raise readers.DataError(f"the index in {root} was built as a whole: streams need one of their own")
    known = stored(register(spark, root, batch), "register")
    parts = long_documents.store_pieces(pieces, scratch(spark, "pieces"))
    arrived = long_documents.documents(parts)
    arrived = arrived if blank else arrived.filter("filled")
    old = known.select("source_path", F.col("doc_pos").alias("_place"), F.col("digest").alias("_digest"), F.col("batch").alias("_batch"))
    changed = arrived.join(old, "source_path", "left").filter(~F.col("digest").eqNullSafe(F.col("_digest")))
    changed = stored(changed, "arrived")
    fresh = changed.filter("_place IS NULL")
    start = known.agg(F.coalesce(F.max("doc_pos") + 1, F.lit(0))).first()[0]
    numbers = readers.sorted_numbers(fresh, "source_path", "_new") if not fresh.isEmpty() else spark.createDataFrame([], "source_path string, _new long")
    placed = changed.join(numbers, "source_path", "left").withColumn("doc_pos", F.coalesce("_place", F.col("_new") + start))
    chunked = providers.embed(pipelines.piece_table(parts, placed, config, scratch(spark, "marked")), provider, normalize=config["embedding"]["normalize"])
    new = stored(chunked.withColumn("batch", F.lit(batch).cast("long")), "ingested")
    # Partitions that hold chunks of changed documents, without those chunks.
    again = changed.filter("_place IS NOT NULL").select("source_path", "_batch")
    index = f"{root}/index"
    rows, emptied = new, []
    if sinks.exists(spark, index) and not again.isEmpty():
        there = spark.read.parquet(index).withColumn("batch", F.col("batch").cast("long"))
        gone = again.select(F.col("source_path").alias("_path"))
        held = there.join(gone, F.col("metadata.source_path") == F.col("_path")).select("year", "month", "batch").distinct()
        touched = there.join(F.broadcast(held), ["year", "month", "batch"], "left_semi") if held.count() <= 10_000 else there.join(held, ["year", "month", "batch"], "left_semi")
        kept = stored(touched.join(gone, F.col("metadata.source_path") == F.col("_path"), "left_anti").filter(F.col("batch") != batch).select(*new.columns), "kept")
        rows = kept.unionByName(new)
        left = rows.select("metadata.year", "metadata.month", "batch").distinct()
        emptied = held.join(left, ["year", "month", "batch"], "left_anti").collect()
    sinks.write_index(rows, index, "merge", ("batch",))
    for r in emptied:
        sinks.remove(spark, f"{index}/year={r['year']}/month={r['month']}/batch={r['batch']}")
    counts = new.groupBy("metadata.source_path").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.size("vector")).alias("dim"))
    entry = placed.join(counts, "source_path").select("source_path", "doc_pos", "year", "month", "digest", "chunks", "dim")
    # The batch counts from here on.
    entry.write.mode("overwrite").parquet(f"{root}/documents/batch={batch}")
    write_manifest(spark, config, provider)


def write_manifest(spark: SparkSession, config: dict, provider) -> dict:
    """The manifest of what the register holds: counting the index itself would cost a scan for each batch."""
    counted = register(spark, config["index_dir"]).agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunk_count"), F.count(F.lit(1)).alias("document_count"), F.coalesce(F.max("dim"), F.lit(0)).alias("embedding_dim"))
    row = pipelines.manifest_row(counted, config, provider).first().asDict(recursive=True)
    sinks.write_one(spark, row, f"{config['index_dir']}/manifest.json")
    return row


def run(spark: SparkSession, config: dict, checkpoint: str, provider=None):
    """Merges what has arrived below data_dir since the checkpoint's last run; a query that ends when all is read.

    A file counts by its name: one that has been read is not read again, changed or not; merge_batch() takes it.
    checkpoint has to lie where driver and executors write, as index_dir has to. pipelines.finish_index() writes the chunk
    file of an index that is to be evaluated.
    """
    provider = provider or pipelines.embedder(config)
    root, years = config["data_dir"], config["document_years"]
    merge = lambda lines, batch: merge_pieces(readers.dated_pieces(lines, root, years), batch, config, provider, blank=False)
    return line_stream(spark, root, years).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Documents of any length: read by lines, kept in pieces, chunked as their whole texts would be.

A file's lines may come from several splits. Consecutive lines of a split make a piece of some PIECE_BYTES, and what
costs time (headings, tables, tokens, cutting texts out) is done by piece, on all cores. What has to run through a
document from its first line to its last, packing, sees the token counts of its blocks only.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, let
from ..sources.scratch import stored_at
from . import chunking

#: Bytes that a piece has about, too few to take whole regions of a small heap; a longer line is a piece of its own.
PIECE_BYTES = 1 << 17
#: Bytes of pieces that go out of Python at a time.
OUT_BYTES = 1 << 20
#: Bytes of a row group of stored pieces, about.
GROUP_BYTES = 16 << 20
#: Rows and pieces that go out of Python at a time.
OUT_ROWS = 512
#: Rows of pieces' facts that are Python's at a time: a row has some values for each block of a piece.
FACT_ROWS = 16
#: A digest is a polynomial of its lines' hashes at BASE modulo a prime: it doesn't depend on where pieces are cut.
PRIME, BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835
BOM = "\ufeff"

KEYS = ["source_path", "block", "at"]
_FACTS = {"at": "long", "bytes": "long", "lines": "long", "digest": "string", "filled": "boolean"}
DOCUMENT = "source_path string, year int, month int, digest string, filled boolean, bom boolean, first_block long, first_at long"
_CUTS = "array<struct<chunk_no:int,part:int,parts:int,s:int,e:int,heading:string,table:boolean>>"


def lines_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The lines of whole texts, as a reader of files gives them: source_path, year, month, file_bytes, block, line.

    Bytes that aren't UTF-8 are replaced here, so the digest of a text with such bytes isn't that of its file.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select("source_path", "year", "month", F.octet_length(text).cast("long").alias("file_bytes"), F.lit(0).cast("long").alias("block"), F.explode(F.split(F.regexp_replace(text, r"\n\z", ""), "\n")).alias("line"))


def _joined(batches):
    """Consecutive lines of a file's split as one row: the columns that they share, _FACTS and the text."""
    out, waiting, at, key, last = [], 0, 0, None, None

    def fresh(shared: dict) -> dict:
        return shared | {"at": at, "bytes": 0, "lines": 0, "digest": 0, "filled": False, "text": []}

    def batch(kinds):
        schema = pa.schema([*kinds, ("at", pa.int64()), ("bytes", pa.int64()), ("lines", pa.int64()), ("digest", pa.string()), ("filled", pa.bool_()), ("text", pa.binary())])
        made = pa.RecordBatch.from_pylist([r | {"digest": f"{r['digest']:032x}", "text": b"\n".join(r["text"]).removesuffix(b"\r")} for r in out], schema)
        return pa.RecordBatch.from_arrays([*made.columns[:-1], made.columns[-1].view(pa.string())], schema.names)

    for b in batches:
        shared = [c for c in b.schema.names if c not in ("line", "_one", "_two", "_some")]
        kinds = [b.schema.field(c) for c in shared]
        lines, one, two, some = b.column("line").cast(pa.binary()).to_pylist(), b.column("_one").to_pylist(), b.column("_two").to_pylist(), b.column("_some").to_pylist()
        ends = np.cumsum([len(x) + 1 for x in lines])
        path, block = b.column("source_path"), b.column("block")
        new = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        turns = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows] if b.num_rows else []
        for lo, end in zip(turns, turns[1:]):
            here = (path[lo].as_py(), block[lo].as_py())
            while lo < end:
                if last is not None and (key != here or last["bytes"] >= PIECE_BYTES):
                    out.append(last)
                    waiting, at, last = waiting + last["bytes"], at + 1, None
                    if waiting >= OUT_BYTES or len(out) >= OUT_ROWS:
                        yield batch(kinds)
                        out, waiting = [], 0
                if last is None:
                    key, last = here, fresh({c: b.column(c)[lo].as_py() for c in shared})
                before = int(ends[lo - 1]) if lo else 0
                hi = min(end, int(np.searchsorted(ends, before + PIECE_BYTES - last["bytes"])) + 1)
                digest = last["digest"]
                for x, y in zip(one[lo:hi], two[lo:hi]):
                    digest = (digest * BASE + ((x << 64) ^ y)) % PRIME
                last |= {"bytes": last["bytes"] + int(ends[hi - 1]) - before, "lines": last["lines"] + hi - lo, "digest": digest, "filled": last["filled"] or any(some[lo:hi])}
                last["text"] += lines[lo:hi]
                lo = hi
    if last is not None:
        out.append(last)
        yield batch(kinds)


def pieces(lines: DataFrame) -> DataFrame:
    """Lines joined to pieces, without the line end after the last one; to be stored before it is used.

    lines: source_path, file_bytes, block, line and what a document's lines share; those of a source_path and block lie in one
    partition and in order. block and at put a document's pieces in order.
    """
    some = F.col("line").rlike(f"[^{WS[1:]}")
    shared = {c: kind for c, kind in lines.dtypes if c != "line"}
    out = ", ".join(f"{c} {kind}" for c, kind in (shared | _FACTS | {"text": "string"}).items())
    return lines.withColumns({"_one": F.xxhash64("line"), "_two": F.xxhash64(F.lit("2"), "line"), "_some": some}).mapInArrow(_joined, out)


def store_pieces(rows: DataFrame, path: str) -> DataFrame:
    """rows that hold a piece's text each, stored at path in row groups of GROUP_BYTES and in pages of a few rows.

    Parquet looks at sizes after a hundred rows first, which here are many megabytes: a page, which its codecs hold twice
    outside the heap, and a row group, which readers may hold as a whole.
    """
    checks = {f"parquet.{of}.size.row.check.{k}": n for of in ("block", "page") for k, n in (("min", 2), ("max", 8))}
    return stored_at(rows, path, **checks, **{"parquet.block.size": GROUP_BYTES})


def _in_order(rows: DataFrame) -> DataFrame:
    """A document's rows one after another in one partition."""
    return rows.repartition("source_path").sortWithinPartitions(*KEYS)


def _documents_of(batches):
    """One document after another: its rows, in order."""
    rows = (r for b in batches for lo in range(0, b.num_rows, FACT_ROWS) for r in b.slice(lo, FACT_ROWS).to_pylist())
    return groupby(rows, lambda r: r["source_path"])


def _summed(batches):
    out = []
    schema = pa.schema([("source_path", pa.string()), ("year", pa.int32()), ("month", pa.int32()), ("digest", pa.string()), ("filled", pa.bool_()), ("bom", pa.bool_()), ("first_block", pa.int64()), ("first_at", pa.int64())])
    for path, rows in _documents_of(batches):
        first, digest, size, filled = None, 0, 0, False
        for r in rows:
            first = first or r
            digest = (digest * pow(BASE, r["lines"], PRIME) + int(r["digest"], 16)) % PRIME
            size, filled = size + r["bytes"], filled or r["filled"]
        bom = size < first["file_bytes"]
        out.append({"source_path": path, "year": first["year"], "month": first["month"], "digest": f"{digest:032x}" + ("-bom" if bom else ""), "filled": filled or bom, "bom": bom, "first_block": first["block"], "first_at": first["at"]})
        if len(out) >= OUT_ROWS:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def documents(stored_pieces: DataFrame) -> DataFrame:
    """One row for each document: source_path, year, month, digest of its lines, filled (not blank), and bom.

    Readers of lines leave out a byte-order mark at a file's start, readers of whole files don't: bom says that one is
    missing, as the lines and their ends are then shorter than the file.
    """
    facts = stored_pieces.select("source_path", "year", "month", "file_bytes", "block", *_FACTS)
    return _in_order(facts).mapInArrow(_summed, DOCUMENT)


def marked(stored_pieces: DataFrame, docs: DataFrame) -> DataFrame:
    """The pieces of docs' documents, taken apart: the struct _p of chunking.piece(). To be stored before it is used."""
    of = docs.select("source_path", "bom", "first_block", "first_at")
    first = F.col("bom") & (F.col("block") == F.col("first_block")) & (F.col("at") == F.col("first_at"))
    whole = F.when(first, F.concat(F.lit(BOM), "text")).otherwise(F.col("text"))
    return stored_pieces.select(*KEYS, "text").join(of, "source_path").select(*KEYS, chunking.piece(whole).alias("_p"))


def _cuts(rows, size: int, overlap: int):
    """Each piece's keys and its parts of its document's chunks."""
    sizes, tables, heads, starts, keys, n, ended = [], [], [], [], [], 0, True
    for r in rows:
        if r["sizes"]:
            keys.append([r[k] for k in KEYS])
            starts.append(n)
        for i, (head, table, tokens) in enumerate(zip(r["headings"], r["tables"], r["sizes"])):
            if i == 0 and r["open"] and not ended:
                sizes[-1] += tokens
                tables[-1] += table
            else:
                sizes.append(tokens)
                tables.append(table)
                heads.append(head if head is not None else heads[-1] if heads else chunking.FIRST_HEADING)
            n += tokens
        ended = r["ended"]
    starts.append(n)
    chunks = chunking.packed(sizes, [t >= chunking.TABLE_LINES for t in tables], size, overlap)
    of: list[list] = [[] for _ in keys]
    for no, (s, e, block, table) in enumerate(chunks):
        lo, hi = bisect_right(starts, s) - 1, bisect_right(starts, e - 1)
        for i in range(lo, hi):
            of[i].append({"chunk_no": no, "part": i - lo, "parts": hi - lo, "s": max(s - starts[i], 0), "e": min(e, starts[i + 1]) - starts[i], "heading": heads[block], "table": table})
    return zip(keys, of), len(chunks)


def chunk_pieces(stored_marked: DataFrame, size: int, overlap: int) -> DataFrame:
    """source_path, chunk_no, heading, content_type, text: the chunks that chunking.chunk_documents() makes of the whole texts.

    A document without tokens is an error that shows its path. Texts stay where their pieces are; only chunks that lie in
    several pieces are put together.
    """
    chunking.check_settings(size, overlap)
    cut = pa.struct([("chunk_no", pa.int32()), ("part", pa.int32()), ("parts", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("heading", pa.string()), ("table", pa.bool_())])
    schema = pa.schema([("source_path", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("cuts", pa.list_(cut))])

    def cuts(batches):
        out = []
        for path, rows in _documents_of(batches):
            placed, n = _cuts(rows, size, overlap)
            if not n:
                raise ValueError(f"no chunks in document {path}")
            for key, of in placed:
                out.append(dict(zip(KEYS, key)) | {"cuts": of})
                if len(out) >= OUT_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    facts = stored_marked.select(*KEYS, *[F.col("_p")[c].alias(c) for c in ("open", "ended", "headings", "tables", "sizes")])
    placed = _in_order(facts).mapInArrow(cuts, f"source_path string, block long, at long, cuts {_CUTS}")
    both = stored_marked.select(*KEYS, F.col("_p.words").alias("words")).join(placed, KEYS)

    def texts(of, cut_out):
        fields = lambda c, text: F.struct(c["chunk_no"].alias("chunk_no"), c["part"].alias("part"), c["heading"].alias("heading"), F.when(c["table"], "table").otherwise("text").alias("content_type"), text.alias("text"))
        return both.filter(F.size(of) > 0).select("source_path", F.explode(cut_out(lambda text: F.transform(of, lambda c: fields(c, text(c))))).alias("_c")).select("source_path", "_c.*")

    def from_words(made):
        return let(F.split("words", " "), lambda words: made(lambda c: F.array_join(F.slice(words, c["s"] + 1, c["e"] - c["s"]), " ")))

    def from_ends(made):
        """A part of a torn chunk lies at its piece's start or end."""
        return made(lambda c: F.call_function("substring_index", F.col("words"), F.lit(" "), F.when(c["s"] == 0, c["e"]).otherwise(c["s"] - c["e"])))

    whole = texts(F.filter("cuts", lambda c: c["parts"] == 1), from_words).drop("part")
    torn = texts(F.filter("cuts", lambda c: c["parts"] > 1), from_ends).groupBy("source_path", "chunk_no", "heading", "content_type")
    mended = torn.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), " ").alias("text"))
    return whole.unionByName(mended)

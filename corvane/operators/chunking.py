"""Documents to chunks: token windows, heading- and table-aware blocks, greedy packing with overlap.

Everything happens within a document's row: no shuffle, no window function. A chunk is an interval of the document's
tokens, so packing sees the blocks' token counts only, and texts are cut out at the end by expressions.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_ENDS, WS, collapse, let, newlines, numeric_token_count, strip, tokens

FIRST_HEADING = "Document"
MAX_HEADING, MAX_TITLE_WORDS, TITLE_SHARE, TABLE_LINES, TABLE_NUMBERS = 180, 14, 0.75, 2, 3
#: Noncharacters that mark headings and blank lines while a text is taken apart; they are no part of any text.
#: The white space of WS and the mark that headings lose: a line is no shorter without them than its heading.
_BLANKS = "#" + "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_HEAD, _BLANK = "￿", "￾"


def check_settings(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("chunk overlap must be at least 0 and less than the chunk size")


def windows(n: Column, size: int, overlap: int) -> Column:
    """array of struct(s, e): windows over n tokens, the last one ending at n."""
    check_settings(size, overlap)
    step = size - overlap
    count = F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct((i * step).cast("int").alias("s"), F.least(i * step + size, n).cast("int").alias("e")))


def token_windows(text: Column, size: int, overlap: int) -> Column:
    """array of texts: sliding windows over white-space tokens."""
    cut = lambda words: F.transform(windows(F.size(words), size, overlap), lambda w: F.array_join(F.slice(words, w["s"] + 1, w["e"] - w["s"]), " "))
    return let(tokens(text), cut)


def is_title(line: Column) -> Column:
    """Mostly upper-case letters, few words, at most one number, no closing punctuation."""
    letters, upper = F.length(F.regexp_replace(line, r"[^\p{L}]", "")), F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    words = F.size(F.split(line, " "))
    return ~line.rlike(r"[.,;:]\z") & (numeric_token_count(line) <= 1) & (letters > 0) & (upper >= TITLE_SHARE * letters) & words.between(1, MAX_TITLE_WORDS)


def heading(line: Column) -> Column:
    """A stripped line's heading, or null: a markdown heading, a table, chart or schedule caption, or a title.

    Cheap tests come first: most lines are too long to be headings and never meet a pattern.
    """
    marked = r"(?d)^#{1,6}" + WS + r"+(.+?)" + WS + r"*\z"

    def plain(compact: Column) -> Column:
        caption = compact.rlike(r"(?iU)^(?:table|chart|schedule)" + WS + r"+[A-Z0-9IVXLC\-.]+\b")
        return F.when((F.length(compact) <= MAX_HEADING) & (compact != "") & (is_title(compact) | caption), compact)

    bare = F.when(F.length(F.translate(line, _BLANKS, "")) <= MAX_HEADING, let(collapse(F.ltrim(line, F.lit("#"))), plain))
    return F.when(line.startswith("#") & line.rlike(marked), collapse(F.regexp_extract(line, marked, 1))).otherwise(bare)


def is_table_line(line: Column) -> Column:
    """Columns set apart by two spaces and more, and three numbers and more."""
    return line.rlike(rf"[^\s]{WS}{{2,}}[^\s]") & (numeric_token_count(line) >= TABLE_NUMBERS)


def content_type(block: Column) -> Column:
    table = lambda lines: (F.size(lines) >= 2) & (F.size(F.filter(lines, is_table_line)) >= TABLE_LINES)
    several = block.rlike(LINE_ENDS) & block.rlike(WS + "{2}")  # without either there is no table
    return F.when(several & let(F.filter(F.split(block, LINE_ENDS), lambda x: strip(x) != ""), table), "table").otherwise("text")


def _marked(text: Column) -> Column:
    """A text's lines, stripped; a blank one is a mark, and a heading follows its mark."""

    def mark(line: Column) -> Column:
        marks = lambda bare: F.when(bare == "", F.lit(_BLANK)).otherwise(F.coalesce(F.concat(F.lit(_HEAD), heading(bare)), bare))
        return let(F.btrim(line, F.lit(_BLANKS[1:])), marks)

    # Looking for the marks costs little, translating looks at each character.
    unmarked = lambda t: F.when(F.contains(t, F.lit(_HEAD)) | F.contains(t, F.lit(_BLANK)), F.translate(t, _HEAD + _BLANK, "")).otherwise(t)
    clean = let(newlines(text), unmarked)
    return F.array_join(F.transform(F.split(clean, "\n"), mark), "\n")


def _paragraphs(section: Column) -> Column:
    return F.filter(F.transform(F.split(section, _BLANK), lambda b: F.btrim(b, F.lit("\n"))), lambda b: b != "")


def blocks(text: Column) -> Column:
    """array of struct(heading, content_type, text): paragraphs, each under the heading last seen.

    Blank lines and headings end a block; a heading is the first line of the block after it. Lines are marked, then
    the text is split at headings and each section at blank lines: no running state is needed.
    """

    sections = F.split(_marked(text), _HEAD)

    def section(s: Column, i: Column) -> Column:
        head = F.when(i == 0, F.lit(FIRST_HEADING)).otherwise(F.regexp_extract(s, r"(?d)^[^\n]*", 0))
        return F.transform(_paragraphs(s), lambda b: F.struct(head.alias("heading"), content_type(b).alias("content_type"), b.alias("text")))

    return F.flatten(F.transform(sections, section))


def piece(text: Column) -> Column:
    """A run of a document's lines as struct(open, ended, headings, tables, sizes, words).

    Of each of its blocks: the heading, null for the one that was last seen before the piece; how many table lines and how
    many tokens it has. words: all tokens, with a space between them. open: the first block goes on with the one before the
    piece, unless that has ended; ended: the piece's last line is blank.
    """
    lines = lambda b: F.when(b.rlike(WS + "{2}"), F.size(F.filter(F.split(b, LINE_ENDS), is_table_line))).otherwise(0)

    def section(s: Column, i: Column) -> Column:
        head = F.when(i > 0, F.regexp_extract(s, r"(?d)^[^\n]*", 0))
        return F.transform(_paragraphs(s), lambda b: F.struct(head.alias("heading"), lines(b).alias("tables"), collapse(b).alias("words")))

    def parted(m: Column) -> Column:
        found = F.filter(F.flatten(F.transform(F.split(m, _HEAD), section)), lambda b: b["words"] != "")
        spaces = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))

        def fields(bs: Column) -> Column:
            return F.struct(
                (~m.startswith(_HEAD) & ~m.startswith(_BLANK)).alias("open"), m.endswith(_BLANK).alias("ended"), F.transform(bs, lambda b: b["heading"]).alias("headings"),
                F.transform(bs, lambda b: b["tables"]).alias("tables"), F.transform(bs, lambda b: spaces(b["words"]) + 1).alias("sizes"), F.array_join(F.transform(bs, lambda b: b["words"]), " ").alias("words"),
            )

        return let(found, fields)

    return let(_marked(text), parted)


_OUT = "array<struct<s:int,e:int,b:int,t:boolean>>"


def packed(sizes: list[int], tables: list[bool], size: int, overlap: int) -> list[tuple[int, int, int, bool]]:
    """pack() of one document: one step for each chunk, which jumps to the first block that doesn't fit any more."""
    ends, marked, out = list(accumulate(sizes)), list(accumulate(tables, initial=0)), []
    n, step = len(sizes), size - overlap
    start = end = at = block = 0
    table = False
    while at < n:
        if start == end:
            while at < n and not sizes[at]:
                at += 1
            if at == n:
                break
            block, table = at, False
        fit = max(at, bisect_right(ends, start + size, at))  # the first block whose end lies beyond the chunk's
        if fit > at:
            end, table, at = ends[fit - 1], table or marked[fit] > marked[at], fit
        if at == n:
            break
        if start < end:
            out.append((start, end, block, table))
        if sizes[at] > size:
            for s in range(0, sizes[at] - size + step, step):
                out.append((ends[at] - sizes[at] + s, ends[at] - sizes[at] + min(s + size, sizes[at]), at, bool(tables[at])))
            start = end = ends[at]
        else:
            start, end, block, table = end - min(overlap, end - start), ends[at], at, table or bool(tables[at])
        at += 1
    if start < end:
        out.append((start, end, block, table))
    return out


def pack(sizes: Column, tables: Column, size: int, overlap: int) -> Column:
    """array of struct(s, e, b, t): token intervals of chunks, the block whose heading they bear, table or not.

    Blocks are added while they fit; a chunk that is full leaves its last `overlap` tokens to the next, which then may
    exceed the size by as many. A block larger than the size ends the chunk and is cut in windows; nothing carries
    over from it. A chunk is a table if any of its blocks is, or was in the chunk that it carries tokens from.

    Only the blocks' token counts go to Python, as Arrow arrays. Folding over them in an expression would copy what has
    been packed so far at each block: time and garbage would grow with the square of a document's blocks.
    """
    check_settings(size, overlap)

    def run(n: pa.Array, t: pa.Array) -> pa.Array:
        rows = [None if x is None else packed(x, y, size, overlap) for x, y in zip(n.to_pylist(), t.to_pylist())]
        flat = [c for r in rows if r for c in r]
        fields = [pa.array([c[k] for c in flat], kind) for k, kind in enumerate([pa.int32(), pa.int32(), pa.int32(), pa.bool_()])]
        cuts = pa.array(list(accumulate((len(r or ()) for r in rows), initial=0)), pa.int32())
        mask = pa.array([r is None for r in rows])
        return pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(fields, ["s", "e", "b", "t"]), mask=mask)

    return F.arrow_udf(run, _OUT)(sizes.cast("array<int>"), tables)


def chunk_id(year: Column, month: Column, number: Column) -> Column:
    return F.format_string("%d_%02d_%05d", year, month, number)


def chunk_documents(docs: DataFrame, size: int, overlap: int, text_col: str = "text", required: str | None = None) -> DataFrame:
    """docs' columns but the text, with chunk_no (from 0), heading, content_type, text: one row for each chunk.

    Documents without tokens give no rows; if required names a column, they are an error that shows its value.
    """
    with_blocks = docs.withColumn("_blocks", F.filter(F.transform(blocks(F.col(text_col)), lambda b: F.struct(b["heading"].alias("heading"), (b["content_type"] == "table").alias("table"), tokens(b["text"]).alias("tokens"))), lambda b: F.size(b["tokens"]) > 0))
    sizes = F.transform("_blocks", lambda b: F.size(b["tokens"]))
    packed = with_blocks.withColumn("_chunks", pack(sizes, F.transform("_blocks", lambda b: b["table"]), size, overlap))
    # Both arrays are needed to cut the texts out before chunks become rows: else each row would carry them.
    def cut_out(words: Column) -> Column:
        return F.transform("_chunks", lambda c: F.struct(F.get(F.col("_blocks"), c["b"])["heading"].alias("heading"), F.when(c["t"], "table").otherwise("text").alias("content_type"), F.array_join(F.slice(words, c["s"] + 1, c["e"] - c["s"]), " ").alias("text")))

    cut = let(F.flatten(F.transform("_blocks", lambda b: b["tokens"])), cut_out)
    if required:
        none = F.raise_error(F.concat(F.lit("no chunks in document "), F.coalesce(F.col(required).cast("string"), F.lit("null"))))
        cut = F.when(F.size("_chunks") > 0, cut).otherwise(none)
    keep = [c for c in docs.columns if c != text_col]
    return packed.select(*keep, F.posexplode(cut).alias("chunk_no", "_c")).select(*keep, "chunk_no", "_c.heading", "_c.content_type", "_c.text")


def index_rows(chunks: DataFrame) -> DataFrame:
    """text and metadata struct of chunks that have year, month and source_path."""
    return chunks.select("text", F.struct("year", "month", "source_path", chunk_id(F.col("year"), F.col("month"), F.col("chunk_no")).alias("chunk_id"), "heading", "content_type").alias("metadata"))

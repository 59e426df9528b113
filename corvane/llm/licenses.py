"""License scans (operator 13), by native expressions alone.

Phrases are looked for word by word. Beyond them, an exact set-similarity join finds every block of words that holds a
license's notice: tokens are ordered by how rare they are in the whole corpus, a block and a template can only agree
if they share a token of both prefixes, and length and position bound what they may share before it is counted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and the labels they give.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: The notices by which works name their licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd-3", "Licensed under the BSD 3-Clause License"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]

#: A block holds a template if it has this share, in percent, of the template's different words.
CONTAINMENT = 85
#: Widths in words: a template goes with the least that it fits in. Blocks are two widths long and begin at each width's
#: multiple, so any run of a width's words lies whole in one of them.
WIDTHS = (16, 64)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def prepared(templates, containment: int, widths) -> list[dict]:
    """The templates' different words, the least number of them a block must hold, and their widths."""
    out = []
    for no, (label, text) in enumerate(templates):
        words = words_of(text)
        fits = [w for w in sorted(widths) if w >= len(words)]
        if not words or not fits:
            raise ValueError(f"a template has from 1 to {max(widths)} words: {text!r}")
        tokens = list(dict.fromkeys(words))
        out.append({"no": no, "label": label, "tokens": tokens, "need": max(1, -(-containment * len(tokens) // 100)), "width": fits[0]})
    return out


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strings(values) -> str:
    return f"array({', '.join(map(_quoted, values))})"


def _lowered(text: Column, tokens: list[str]) -> Column:
    """A-Z lower-cased, as far as tokens of ASCII can tell: lower() is many times as fast as a translation by character.

    It changes letters beyond ASCII too, which then still are no part of such a token; the Kelvin sign alone would become
    one of A-Z, and is made another letter first. Tokens with other characters need the translation.
    """
    if not all(t.isascii() for t in tokens):
        return ascii_lower(text)
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b")))


def _rows(docs: DataFrame, id_col: str, text_col: str, tokens: list[str]) -> DataFrame:
    """_row tells rows apart that repeat an id with another text; rows alike in both are one document given twice."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.regexp_extract_all(_lowered(text, tokens), F.lit(WORD), F.lit(0))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), text).alias("_row"), words.alias("_words"))


def rarest_first(rows: DataFrame, tokens: list[str]) -> list[str]:
    """The templates' tokens by the number of rows that hold them, of all rows. What comes to the driver is one count a token."""
    held = rows.select(F.explode(F.array_intersect(F.expr(_strings(tokens)), "_words")).alias("token"))
    count = dict(held.groupBy("token").agg(F.count(F.lit(1))).collect())
    return sorted(tokens, key=lambda t: (count.get(t, 0), t))


def _prefix_index(spark: SparkSession, templates: list[dict], order: list[str]) -> DataFrame:
    """A row for each template's token that its prefix holds: those beyond can't be the first that a block shares with it."""
    rank, entries = {t: k for k, t in enumerate(order)}, []
    for t in templates:
        tokens = sorted(t["tokens"], key=rank.get)
        known = f"{t['width']}, {t['no']}, {_quoted(t['label'])}, {t['need']}, {_strings(tokens)}"
        entries += [f"({_quoted(token)}, {i}, {known})" for i, token in enumerate(tokens[: len(tokens) - t["need"] + 1])]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(entries)} AS t(token, i, width, no, label, need, tokens)")


def _blocks(words: Column, width: int, prefix: Column, known: Column) -> Column:
    """An array of (width, start, shared) for blocks with a token of a prefix; shared: the tokens that templates know, rarest first."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - width - 1, F.lit(0)), F.lit(width))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(words, s + 1, 2 * width).alias("block")))
    probed = F.filter(cut, lambda b: F.arrays_overlap(b["block"], prefix))
    return F.transform(probed, lambda b: F.struct(F.lit(width).alias("width"), b["start"].alias("start"), F.array_intersect(known, b["block"]).alias("shared")))


def candidate_blocks(words: Column, templates: list[dict], order: list[str]) -> Column:
    """An array of the blocks, of all widths, that share a token with the prefix of a template of their width."""
    rank, blocks, prefixes = {t: k for k, t in enumerate(order)}, [], set()
    for width in sorted({t["width"] for t in templates}):
        own = [t for t in templates if t["width"] == width]
        prefix = sorted({x for t in own for x in sorted(t["tokens"], key=rank.get)[: len(t["tokens"]) - t["need"] + 1]})
        prefixes |= set(prefix)
        blocks.append(_blocks(words, width, F.expr(_strings(prefix)), F.expr(_strings(sorted({x for t in own for x in t["tokens"]}, key=rank.get)))))
    none = F.array().cast("array<struct<width:int,start:int,shared:array<string>>>")
    # A document without any prefix token is left after one probe of its words.
    return F.when(F.arrays_overlap(words, F.expr(_strings(sorted(prefixes)))), F.concat(*blocks)).otherwise(none)


def matching_blocks(rows: DataFrame, templates: list[dict], order: list[str]) -> DataFrame:
    """_id, _row, width, start, no, label, containment, matched: every block that holds enough of a template, exactly.

    rows: _id, _row, _cut (candidate blocks). The index is as small as the templates, which are a parameter, and is
    broadcast. A block and a template are compared where the first token that they share stands in both prefixes.
    """
    tokens = rows.select("_id", "_row", F.inline("_cut")).select("*", F.posexplode("shared").alias("j", "token"))
    met = tokens.join(F.broadcast(_prefix_index(rows.sparkSession, templates, order)), ["token", "width"])
    long_enough = F.size("shared") >= F.col("need")
    in_place = F.least(F.size("tokens") - F.col("i"), F.size("shared") - F.col("j")) >= F.col("need")
    first = ~F.arrays_overlap(F.slice("shared", F.lit(1), F.col("j")), F.slice("tokens", F.lit(1), F.col("i")))
    found = met.filter(long_enough & in_place & first).withColumn("matched", F.array_intersect("tokens", "shared"))
    return found.filter(F.size("matched") >= F.col("need")).select("_id", "_row", "width", "start", "no", "label", (F.size("matched") / F.size("tokens")).alias("containment"), "matched")


def _told_apart(found: DataFrame) -> DataFrame:
    """Of the templates that a block holds, those whose words no other explains: `CC BY 4.0` within `CC BY-NC 4.0` goes.

    At most as many templates meet in a block as there are.
    """
    per_block = found.groupBy("_id", "_row", "width", "start").agg(F.collect_set(F.struct("no", "label", "containment", "matched")).alias("m"))

    def explained(a: Column, b: Column) -> Column:
        within = F.size(F.array_except(a["matched"], b["matched"])) == 0
        return within & ((F.size(b["matched"]) > F.size(a["matched"])) | (b["containment"] > a["containment"]))

    kept = F.filter("m", lambda a: ~F.exists("m", lambda b: explained(a, b)))
    each = per_block.select("_id", "_row", "width", "start", F.inline(kept))
    return each.groupBy("_id", "_row").agg(F.collect_set(F.struct("label", F.col("start").cast("long").alias("start"), F.col("width").alias("width"), "containment")).alias("blocks"))


def phrase_places(words: Column, phrases=PHRASES) -> Column:
    """An array of (label, start) for all places where a phrase's words stand one after the other."""
    out = []
    for label, phrase in phrases:
        parts = words_of(phrase)
        at = F.sequence(F.lit(0), F.size(words) - len(parts))

        possible = (F.size(words) >= len(parts)) & _all([F.array_contains(words, p) for p in parts])
        out.append(F.when(possible, _starts(words, at, parts, label)).otherwise(F.array().cast("array<struct<label:string,start:bigint>>")))
    return F.concat(*out)


def _starts(words: Column, at: Column, parts: list[str], label: str) -> Column:
    found = F.filter(at, lambda i: _all([F.get(words, i + k) == p for k, p in enumerate(parts)]))
    return F.transform(found, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, containment: int = CONTAINMENT, widths=WIDTHS
) -> DataFrame:
    """One row per row of docs: id, n_words, places (label, start) of phrases, blocks (label, start, width, containment).

    Starts are numbers of words, from 0; a block is two widths of words from its start. Null texts count as empty and
    have neither; null and repeated ids give a row each, rows alike in id and text the same. Very long texts are taken
    whole, other columns are ignored, an empty table gives no rows.

    Texts are read twice, for the tokens' frequencies and for what is kept of each: counts, places and candidate blocks.
    """
    known = prepared(templates, containment, widths)
    tokens = sorted({x for t in known for x in t["tokens"]})
    rows, words = _rows(docs, id_col, text_col, [*tokens, *(w for _, p in phrases for w in words_of(p))]), F.col("_words")
    order = rarest_first(rows, tokens)
    own = rows.select("_id", "_row", F.size(words).cast("long").alias("n_words"), phrase_places(words, phrases).alias("places"), candidate_blocks(words, known, order).alias("_cut"))
    own = materialise(own, "license-rows")
    blocks = _told_apart(matching_blocks(own, known, order)).withColumnsRenamed({"_id": "_id2", "_row": "_row2"})
    both = own.join(blocks, (F.col("_row") == F.col("_row2")) & F.col("_id").eqNullSafe(F.col("_id2")), "left")
    none = F.array().cast("array<struct<label:string,start:bigint,width:int,containment:double>>")
    return both.select(F.col("_id").alias(id_col), "n_words", "places", F.coalesce("blocks", none).alias("blocks"))


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    """All documents through license_scan(). score: 1 where a phrase stands, else the largest containment of a template found, else 0."""
    found = license_scan(table(spark, sf_dir, "documents"))
    starts = F.col("places.start")
    listed = lambda labels: F.array_join(F.array_sort(labels), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(F.array_distinct("places.label")).alias("base_labels"),
        listed(F.array_union("places.label", "blocks.label")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
    )


def _list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def oracle(phrases=PHRASES, templates=TEMPLATES, containment: int = CONTAINMENT, widths=WIDTHS) -> str:
    """The same by comparing every block with every template."""
    known = ", ".join(f"({t['no']}, '{t['label']}', {_list(t['tokens'])}, {t['need']}, {t['width']})" for t in prepared(templates, containment, widths))
    said = ", ".join(f"('{label}', {_list(words_of(p))})" for label, p in phrases)
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
),
ph(label, p) AS (VALUES {said}),
sp AS (SELECT doc_id, ws, label, p, unnest(range(len(ws) - len(p) + 1)) AS i FROM d, ph),
base AS (
  SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list_sort(list_distinct(list(label))) AS labels
  FROM sp WHERE ws[i + 1] = p[1] AND ws[i + 1:i + len(p)] = p GROUP BY doc_id
),
te(no, label, tokens, need, width) AS (VALUES {known}),
st AS (SELECT doc_id, ws, width, unnest(range(0, greatest(len(ws) - width, 1), width)) AS s FROM d, (SELECT DISTINCT width FROM te)),
bl AS (SELECT doc_id, width, s, list_distinct(ws[s + 1:s + 2 * width]) AS b FROM st),
hit AS (
  SELECT doc_id, width, s, no, label, list_intersect(tokens, b) AS m, len(tokens) AS size
  FROM bl JOIN te USING (width) WHERE len(list_intersect(tokens, b)) >= need
),
best AS (
  SELECT * FROM hit a WHERE NOT EXISTS (
    SELECT 1 FROM hit b WHERE a.doc_id = b.doc_id AND a.width = b.width AND a.s = b.s
      AND len(list_intersect(a.m, b.m)) = len(a.m) AND (len(b.m) > len(a.m) OR len(b.m) / b.size > len(a.m) / a.size)
  )
),
more AS (SELECT doc_id, list(label) AS labels, max(len(m) / size) AS c FROM best GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


ORACLE = oracle()

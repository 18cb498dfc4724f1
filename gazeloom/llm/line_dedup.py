"""Line dedup: lines that many documents share stay in one of them.

Every line becomes (document, 128-bit hash of its key). Distinct pairs are counted per hash, the hashes
over the limit are joined back to the pairs, and each document gets the set of hashes it must drop. Texts
are read twice and shuffled once; lines travel as hashes only.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeloom.llm.common import materialise, packed, rows, slices, unpacked, utf8

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key's hash, or None for a key that is too short to count."""
    key = line.strip(BLANK).lower()  # of bytes: lowers A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with ``text`` cut down to the kept lines, and n_lines, n_dropped, kept_sha256.

    A line whose key (blank stripped, A-Z lowered) has ``min_chars`` code points or more and occurs in
    ``min_docs`` documents or more stays in the largest doc_id only, there as often as it occurs.
    Null text: one empty line. Rows of equal doc_id are one document when counting, each is returned.
    Null doc_id: all such rows count as one document, smaller than any other. Other columns stay; those named like a result are replaced.
    """
    pair_schema = pa.schema([("doc_id", pa.int64()), ("h", pa.binary())])

    def pairs(batches):
        for batch in batches:
            for part in slices(batch):
                ids, hashes = [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), utf8(part)):
                    found = {line_key(x, min_chars) for x in text.split(b"\n")}
                    found.discard(None)
                    hashes.extend(found)
                    ids.extend([doc] * len(found))
                yield rows(pair_schema, ids, hashes)

    lines = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pairs, "doc_id long, h binary"), "lines")
    shared = materialise(lines.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
                         .where(F.col("n") >= min_docs).select("h", "keeper"), "shared")
    drops = (lines.join(shared, "h").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
             .groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("h").alias("_drop")))

    own = packed(docs, "doc_id", "text")
    marked = own.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    out = (marked.select(*own.columns, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"),
                         F.lit("").alias("kept_sha256")).schema)

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                texts, n_lines, n_dropped, digests = [], [], [], []
                for text, drop in zip(utf8(part), part.column("_drop").to_pylist()):
                    all_lines = text.split(b"\n")
                    gone = set(drop or ())
                    kept = [x for x in all_lines if line_key(x, min_chars) not in gone] if gone else all_lines
                    kept_text = b"\n".join(kept)
                    texts.append(kept_text.decode())
                    n_lines.append(len(all_lines))
                    n_dropped.append(len(all_lines) - len(kept))
                    digests.append(hashlib.sha256(kept_text).hexdigest())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "text": pa.array(texts, part.column("text").type), "_rest": part.column("_rest"),
                    "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept_sha256": digests})

    return unpacked(marked.mapInArrow(cut, out), docs, "n_lines", "n_dropped", "kept_sha256")


ORACLE = """
WITH l AS (
  SELECT doc_id, i, lines[i] AS line, translate(regexp_replace(lines[i], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {docs}) d, unnest(range(1, len(lines) + 1)) t(i)),
h AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
k AS (SELECT l.doc_id, l.i, l.line, h.key IS NOT NULL AND l.doc_id <> h.keeper AS gone FROM l LEFT JOIN h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id"""

"""Quality rules: counts of a text by itself, and lines that too many documents of a host share.

Lines are normalised (A-Z as a-z, digits as 0, words joined by one space) and hashed. A line is above the limit of its
host if it stands in more than `line_docs` documents of the host and in more than `line_percent` % of them; copies
of a line in one document count once. Such lines are removed (`keep_cleaned` returns the texts without them); a document is depleted, and rejected, if fewer than
`left_words` words or less than `left_percent` % of its words are left.

One pass over the texts leaves the counts and the line hashes of each document, which are written; the frequencies
are counts of those rows, summed on the map side, and only lines above the limit are joined back.

Null or empty text: all counts 0, base_failed. A null host is a host of its own. Repeated rows count as documents of
their own; a null doc_id stays null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.llm.hashing import text_hash
from tephra.llm.shared import folder, spread
from tephra.llm.text import LOWER, Hashes, chunks, covered, utf8, word_hashes, words

MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
LINE_DOCS, LINE_PERCENT, LEFT_WORDS, LEFT_PERCENT = 10, 10, 10, 25

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
NORMAL = LOWER.copy()
NORMAL[ord("0") : ord("9") + 1] = ord("0")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = "doc_id long, host string, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS) + ", line array<long>, line_words array<int>"


def _per_document(flag_sums: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flag_sums))[off])


def _first(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are the first of their key in their document, and the number of each entry's key."""
    by = np.lexsort((np.arange(len(key)), key, of))
    new = np.ones(len(by), bool)
    new[1:] = (key[by][1:] != key[by][:-1]) | (of[by][1:] != of[by][:-1])
    first, group = np.zeros(len(by), bool), np.empty(len(by), np.int64)
    first[by[new]] = True
    group[by] = np.cumsum(new) - 1
    return first, group


def _lines(buf: np.ndarray, off: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: start and end byte, first word and the one after the last, document."""
    edge = np.flatnonzero(buf == 0x0A)
    line_start = np.unique(np.concatenate([off[:-1], edge + 1]))
    line_start = line_start[line_start < off[-1]]
    line_end = np.append(line_start[1:], off[-1])
    newline = buf[line_end - 1] == 0x0A if len(buf) else np.zeros(0, bool)
    line_end = line_end - newline
    first_word = np.searchsorted(start, np.append(line_start, off[-1]))
    has = np.diff(first_word) > 0
    doc_of_line = np.searchsorted(off, line_start, "right") - 1
    return line_start[has], line_end[has], first_word[:-1][has], first_word[1:][has], doc_of_line[has]


def _measure(buf: np.ndarray, off: np.ndarray, window: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts by document; distinct normalised lines of each document: hash, words, and offsets."""
    n_docs = len(off) - 1
    start, end, of = words(buf, off)
    doc_of_word = np.repeat(np.arange(n_docs), np.diff(of))
    in_word = covered(len(buf), start, end)
    out = {"n_words": np.diff(of), "word_chars": _per_document(in_word & ((buf & 0xC0) != 0x80), off), "n_symbols": _per_document(SYMBOL[buf], off)}

    # windows of words that occur again in the text
    h = Hashes(word_hashes(buf, start, end)).every(window)
    same = doc_of_word[window - 1 :] == doc_of_word[: len(h)] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(same)
    _, group = _first(h[at], doc_of_word[at])
    again = at[np.bincount(group)[group] > 1] if len(at) else at
    out["n_repeat_words"] = _per_document(covered(len(start), again, again + window), of)

    # raw lines for repeats inside the text, normalised for the frequency among documents
    line_start, line_end, a, b, doc_of_line = _lines(buf, off, start)
    first, _ = _first(Hashes.of_bytes(buf).of(line_start, line_end), doc_of_line)
    out["n_dup_lines"] = np.bincount(doc_of_line[~first], minlength=n_docs)
    key = Hashes(word_hashes(NORMAL[buf], start, end)).of(a, b)
    first, group = _first(key, doc_of_line)
    n_words = np.bincount(group, b - a).astype(np.int32) if len(group) else np.zeros(0, np.int32)
    return out, key[first], n_words[group[first]], np.append(0, np.cumsum(np.bincount(doc_of_line[first], minlength=n_docs)))


def _stats(window: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch["text"])
            for i, j in chunks(off):
                counts, key, n_words, cut = _measure(buf[off[i] : off[j]], off[i : j + 1] - off[i], window)
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v)) for v in (key.view(np.int64), n_words)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][i:j], batch["host"][i:j], batch["text_hash"][i:j], *(pa.array(counts[c], pa.int64()) for c in COUNTS), *lists], ["doc_id", "host", "text_hash", *COUNTS, "line", "line_words"])

    return f


def _clean(schema_names: list[str], text: str):
    """Texts without the lines whose normalised hash is in the row's __gone; what is left is joined as it was parted."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, column = batch["__gone"], batch[text]
            rows = np.flatnonzero(pa.compute.fill_null(pa.compute.list_value_length(gone), 0).to_numpy(zero_copy_only=False) > 0)
            if len(rows):
                some = column.take(pa.array(rows))
                buf, off = utf8(some)
                cleaned = []
                for i, j in chunks(off):
                    part, at = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                    start, end, _ = words(part, at)
                    line_start, _, a, b, of = _lines(part, at, start)
                    key = Hashes(word_hashes(NORMAL[part], start, end)).of(a, b).view(np.int64)
                    cut = np.searchsorted(of, np.arange(j - i + 1))
                    for d in range(j - i):
                        own = slice(cut[d], cut[d + 1])
                        out = set(line_start[own][np.isin(key[own], gone[int(rows[i + d])].values.to_numpy())].tolist())
                        left, pos = [], int(at[d])
                        for line in part[at[d] : at[d + 1]].tobytes().split(b"\n"):
                            if pos not in out:
                                left.append(line)
                            pos += len(line) + 1
                        cleaned.append(b"\n".join(left).decode())
                mask = np.zeros(batch.num_rows, bool)
                mask[rows] = True
                column = pa.compute.replace_with_mask(column, pa.array(mask), pa.array(cleaned, column.type))
            yield pa.RecordBatch.from_arrays([column if c == text else batch[c] for c in schema_names], schema_names)

    return f


def line_frequency_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", *, min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT,
    line_docs: int = LINE_DOCS, line_percent: int = LINE_PERCENT, left_words: int = LEFT_WORDS, left_percent: int = LEFT_PERCENT,
) -> DataFrame:
    """(doc_id, the counts, base_failed, kept, n_removed_lines, n_left_words, row, host, text_hash, removed_lines) of every row.

    `row` numbers rows; host and text_hash, with doc_id, tell which rows a verdict is about. removed_lines: hashes of
    the normalised lines above the limits, NULL where there are none.
    """
    folder(docs.sparkSession)
    own = spread(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("\x00")).alias("host"), text_hash(F.col(text)).alias("text_hash"))
    stats = own.mapInArrow(_stats(REPEAT_WINDOW), STATS).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    hosts = stats.groupBy("host").agg(F.count("*").alias("host_docs"))
    lines = stats.select("row", "host", F.explode(F.arrays_zip("line", "line_words")).alias("x")).select("row", "host", F.col("x.line").alias("line"), F.col("x.line_words").alias("words"))
    common = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > line_docs)
    common = common.join(hosts, "host").where(F.col("n") * 100 > F.col("host_docs") * line_percent).select("host", "line")
    removed = lines.join(common, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("gone"), F.count("*").alias("n_removed_lines"), F.collect_list("line").alias("removed_lines"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    return stats.drop("line", "line_words").join(removed, "row", "left").select(
        "doc_id", *COUNTS, base.alias("base_failed"),
        (~base & (left >= left_words) & (left * 100 >= F.col("n_words") * left_percent)).alias("kept"),
        F.coalesce("n_removed_lines", F.lit(0)).alias("n_removed_lines"), left.alias("n_left_words"), "row", "host", "text_hash", "removed_lines",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row", "host", "text_hash", "removed_lines")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, chr(1)) AS host FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
a AS (SELECT r, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars FROM w),
win AS (SELECT r, i, array_to_string(w[i:i + {REPEAT_WINDOW - 1}], ' ') AS g FROM w, unnest(range(1, len(w) - {REPEAT_WINDOW - 2})) t(i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM again, range({REPEAT_WINDOW}) t(k) GROUP BY r),
ln AS (SELECT r, host, unnest(string_split(text, chr(10))) AS l FROM d),
lw AS (SELECT r, host, l, regexp_extract_all(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^\x20\x09-\x0D]+') AS w FROM ln),
lines AS (SELECT r, host, l, array_to_string(w, ' ') AS n, len(w) AS c FROM lw WHERE len(w) > 0),
dup AS (SELECT r, (count(*) - count(DISTINCT l))::BIGINT AS n_dup_lines FROM lines GROUP BY r),
hosts AS (SELECT host, count(*) AS host_docs FROM d GROUP BY host),
common AS (SELECT host, n FROM (SELECT host, n, count(DISTINCT r) AS c FROM lines GROUP BY host, n) JOIN hosts USING (host) WHERE c > {LINE_DOCS} AND c * 100 > host_docs * {LINE_PERCENT}),
gone AS (SELECT r, sum(c)::BIGINT AS gone, count(DISTINCT n)::BIGINT AS n_removed_lines FROM lines JOIN common USING (host, n) GROUP BY r),
f AS (
  SELECT doc_id, n_words, word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_lines, 0) AS n_removed_lines, n_words - coalesce(gone, 0) AS n_left_words
  FROM d JOIN a USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_left_words >= {LEFT_WORDS} AND n_left_words * 100 >= n_words * {LEFT_PERCENT} AS kept, n_removed_lines, n_left_words
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM f)
"""


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The rows of `docs` that aren't rejected, with all their columns."""
    gone = line_frequency_rules(docs, doc_id, text, host, **limits).where(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("host").alias("__host"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (text_hash(F.col(text)) == F.col("__hash")) & (F.coalesce(F.col(host).cast("string"), F.lit("\x00")) == F.col("__host"))
    return docs.join(gone, same, "left_anti")


def keep_cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", n_chars: str = "n_chars", **limits) -> DataFrame:
    """The rows of `docs` that aren't rejected, with all their columns, and without the lines above the limits.

    The lines that stay are joined as they were parted. Where a line went, a column `n_chars` is the number of
    characters that are left; other rows keep theirs.
    """
    of = line_frequency_rules(docs, doc_id, text, host, **limits).where(~F.col("kept") | F.col("removed_lines").isNotNull())
    of = of.select(F.col("doc_id").alias("__id"), F.col("host").alias("__host"), F.col("text_hash").alias("__hash"), F.col("kept").alias("__kept"), F.col("removed_lines").alias("__gone"))
    of = of.dropDuplicates(["__id", "__host", "__hash"])  # rows of one key have one text and one host, so one verdict
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (text_hash(F.col(text)) == F.col("__hash")) & (F.coalesce(F.col(host).cast("string"), F.lit("\x00")) == F.col("__host"))
    left = docs.join(of, same, "left").where(F.coalesce("__kept", F.lit(True))).select(*[F.col(f"`{c}`") for c in docs.columns], "__gone")
    out = left.mapInArrow(_clean([*docs.columns, "__gone"], text), left.schema)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col("__gone").isNotNull(), F.length(text).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return out.drop("__gone")

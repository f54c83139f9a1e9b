"""Quality rules: repetition found with suffix arrays.

For a block of documents at a time, the suffixes of their word sequences are
sorted by prefix doubling; words carry their document's number, so no match
crosses documents.  Common prefixes of neighbours in the suffix array come from
the doubling levels.  An interval of the array with common prefix l is a
substring of l words that repeats; the longest one at each word is the larger
of its two neighbours' common prefixes.  The union of those spans is what a
document repeats; two limits, on the covered share and on the longest repeat,
give the verdict.

Cost: one pass, no exchange; each document is handled alone, and a block holds
``BLOCK_WORDS`` words or one longer document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .suffixes import ranked, refine

BLOCK_WORDS = 400_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
MIN_REPEAT = 10  # words; shorter repeats are ordinary language
MAX_COVERED_PERCENT = 30  # of the words, by repeats of MIN_REPEAT words and more
MAX_LONGEST = 150  # words

STATS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("covered_words", T.LongType()),
        T.StructField("longest_repeat", T.LongType()),
    ]
)


def repeats(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array (places), its neighbours' common prefixes, and by place the longest repeat that starts there.

    ``words``: numbers of words; ``doc``: the document of each, not decreasing.
    ``lcp[k]`` is between places ``sa[k - 1]`` and ``sa[k]``.
    """
    n = len(words)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    rank, todo = ranked(key)
    levels = [(1, rank.astype(np.int32))]
    step = 1
    while len(todo):
        rank, todo = refine(rank, step, todo)
        step *= 2
        levels.append((step, rank.astype(np.int32)))
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    if n > 1:
        live = np.arange(1, n)
        live = live[levels[0][1][sa[live - 1]] == levels[0][1][sa[live]]]
        left, right, found = sa[live - 1].copy(), sa[live].copy(), np.zeros(len(live), np.int64)
        for width, ranks in reversed(levels):
            fits = (left < n) & (right < n)
            same = np.zeros(len(live), bool)
            same[fits] = ranks[left[fits]] == ranks[right[fits]]
            found[same] += width
            left[same] += width
            right[same] += width
        lcp[live] = found
    longest = np.zeros(n, np.int64)
    longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return sa, lcp, longest


def covered(longest: np.ndarray, at_least: int) -> np.ndarray:
    """Which words the repeats of ``at_least`` words and more cover."""
    n = len(longest)
    starts = np.flatnonzero(longest >= at_least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + longest[starts], -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str | None]) -> list[tuple[int, ...]]:
    """STATS for each text."""
    ids: dict[bytes, int] = {}
    known = ids.setdefault
    numbers, lengths, rows = [], [], []
    for text in texts:
        text = text or ""
        words = text.encode("utf-8", "surrogatepass").split()  # ASCII whitespace alone
        numbers.append(np.fromiter((known(w, len(ids)) for w in words), np.int64, len(words)))
        lengths.append(len(words))
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        rows.append(
            (
                len(words),
                len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
                sum(map(text.count, "#*$%&|<>")),
                len(lines) - len(set(lines)),
            )
        )
    doc = np.repeat(np.arange(len(texts)), lengths)
    _, _, longest = repeats(np.concatenate(numbers) if numbers else np.zeros(0, np.int64), doc)
    base = np.bincount(doc[covered(longest, WINDOW)], minlength=len(texts))
    much = np.bincount(doc[covered(longest, MIN_REPEAT)], minlength=len(texts))
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, doc, longest)
    return [(*row, int(a), int(b), int(c)) for row, a, b, c in zip(rows, base, much, most, strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        stats, start, held = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t or "") // 5
            if held >= BLOCK_WORDS or i + 1 == len(texts):
                stats += measure(texts[start : i + 1])
                start, held = i + 1, 0
        columns = [batch.column(i) for i in range(batch.num_columns)]
        made = [pa.array([s[k] for s in stats], pa.int64()) for k in range(len(STATS))]
        yield pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays(made, names=STATS.names)], schema=schema)


def with_repetition(df: DataFrame, text: str = "text", into: str = "stats") -> DataFrame:
    """``df`` with the struct column ``into`` of STATS, counted over the whole text.

    A null text counts as an empty one: all zero.  All rows and columns stay,
    repeated rows too; a column already named ``into`` is replaced.
    """
    df = df.drop(*[c for c in df.columns if c.lower() == into.lower()])
    out = T.StructType([*df.schema.fields, T.StructField(into, STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            if schema is None:
                made = pa.struct([pa.field(f, pa.int64()) for f in STATS.names])
                schema = pa.schema([*batch.schema, pa.field(into, made)])
            yield from _blocks(iter([batch]), text, schema)

    return df.mapInArrow(run, out)


def verdict(stats: str = "stats") -> tuple[F.Column, F.Column]:
    """(base_failed, kept) from the struct of with_repetition.

    kept is false where the base rules fail, where repeats of MIN_REPEAT words
    and more cover over MAX_COVERED_PERCENT of the words, or where the longest
    repeat has over MAX_LONGEST words.
    """
    s = F.col(stats)
    failed = (s["n_words"] < MIN_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MAX_REPEAT_PERCENT)
    bad = (s["covered_words"] * 100 > s["n_words"] * MAX_COVERED_PERCENT) | (s["longest_repeat"] > MAX_LONGEST)
    return failed, ~failed & ~bad


def op8_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    failed, kept = verdict()
    return with_repetition(docs).select(
        "doc_id", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines", "stats.n_repeat_words",
        failed.alias("base_failed"), kept.alias("kept"), "stats.covered_words", (F.col("stats.longest_repeat") > MAX_LONGEST).alias("long_repeat"),
    )


QUERIES = {"op8_suffix_repetition": op8_suffix_repetition}


def _windows(n: int) -> str:
    """SQL: by doc and place, whether the window of n words that starts there is found twice."""
    return f"""
  SELECT row, i, count(*) OVER (PARTITION BY row, key) > 1 AS twice FROM (
    SELECT row, i, md5(array_to_string(list_slice(w, i, i + {n - 1}), ' ')) AS key
    FROM (SELECT row, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n}))"""


def _cover(n: int) -> str:
    """SQL: by doc, how many words the windows of n words found twice cover."""
    return f"""
  SELECT row, count(*) FILTER (over) AS n FROM (
    SELECT p.row, max(coalesce(twice, false)) OVER (PARTITION BY p.row ORDER BY p.i ROWS {n - 1} PRECEDING) AS over
    FROM places p LEFT JOIN ({_windows(n)}) t ON p.row = t.row AND p.i = t.i) GROUP BY row"""


ORACLES = {
    "op8_suffix_repetition": f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), places AS (SELECT row, unnest(range(1, len(w) + 1)) AS i FROM d),
base AS ({_cover(WINDOW)}),
much AS ({_cover(MIN_REPEAT)}),
most AS (SELECT row, max(twice) AS longer FROM ({_windows(MAX_LONGEST + 1)}) GROUP BY row),
s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(base.n, 0)::BIGINT AS n_repeat_words, coalesce(much.n, 0)::BIGINT AS covered_words, coalesce(longer, false) AS long_repeat
  FROM d LEFT JOIN base USING (row) LEFT JOIN much USING (row) LEFT JOIN most USING (row)
)
SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed,
  NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}
    OR covered_words * 100 > n_words * {MAX_COVERED_PERCENT} OR long_repeat) AS kept
FROM s
"""
}

"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of ``PASSAGE`` words.  Words of the
benchmark span the columns of a TF-IDF matrix with a row for each passage of the
corpus; its document frequencies cover all passages.  A randomised SVD finds
the leading right singular vectors: a random mixture of the items' vectors is
multiplied by A'A in one distributed pass, whose partial sums (columns x rank)
are added up by column stripes, and the vectors follow from that image by the
Nystroem form.  Words outside the benchmark are one more direction
of a passage, which no item has.  Passages and items are compared by cosine in
that space.  Each candidate is then checked by the
longest common subsequence of its words with the item's, and by whether the
item's answer, its last sentence, is in it too.

Frequent words don't count in that space, and items that are copied often are
made of them, so a second, exact way adds every passage around which enough of
an item's words are present, whatever their weight: it counts them by blocks of
``STRIDE`` words, and takes for granted the most frequent ``ASSUMED`` of the item.

The benchmark is the stated query set: items are taken in blocks of
``BLOCK_ITEMS``, whose vocabulary bounds what is broadcast; each block is held
against all passages.  Texts are read once, as word numbers that are written
beside the rows, and never exchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import free
from .scratch import written

PASSAGE = 64
STRIDE = PASSAGE // 2
RANK = 224
MAX_SHARE = 0.01  # words in more passages than this don't count in the latent space
MIN_COSINE = 0.25  # of the part of the item that the space holds
SURE = 0.8  # share of the item's words in common order that is enough alone,
LIKELY = 0.55  # and with the answer
ANSWER = 0.75  # share of the answer's words that makes it present
ASSUMED = 0.25  # share of an item's words, the most frequent, that the exact way doesn't look up
GROUP_ITEMS = 256  # counted at a time,
GROUP_BLOCKS = 8192  # over so many blocks of words, or one text
GROUP_PAIRS = 8192  # aligned at a time
BLOCK_ITEMS = 4000
BLOCK_WORDS = 200_000
STRIPES = 16

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Items:
    """A block of benchmark items: ids, word numbers, how many words the answer has, and the vocabulary."""

    ids: list[int | None]
    tokens: list[list[int]]
    answers: list[int]
    vocabulary: dict[str, int]


def read_items(rows: list[tuple[int | None, str | None]]) -> Items:
    """Items without words are left out: nothing can hold them."""
    vocabulary: dict[str, int] = {}
    out = Items([], [], [], vocabulary)
    for item, text in rows:
        said = words(text)
        if said:
            parts = [n for n in (len(words(p)) for p in _SENTENCE.split(text)) if n]
            out.ids.append(item)
            out.tokens.append([vocabulary.setdefault(w, len(vocabulary)) for w in said])
            out.answers.append(parts[-1])
    return out


OUTSIDE = -1


def numbered(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    """The number of each word of the text, OUTSIDE for those that the benchmark lacks."""
    said = words(text)
    return np.fromiter(map(vocabulary.get, said, repeat(OUTSIDE)), np.int32, len(said))


@dataclass
class Passages:
    """Word counts of passages: ``row`` (not decreasing), ``column``, ``count``; of each passage the text, its first word and how many are outside."""

    row: np.ndarray
    column: np.ndarray
    count: np.ndarray
    text: np.ndarray
    start: np.ndarray
    outside: np.ndarray


def passages(texts: list[np.ndarray], counts: np.ndarray, overlap: bool) -> Passages:
    """Every passage of the texts, each STRIDE words or, without ``overlap``, each PASSAGE words; ``counts`` says which columns are counted."""
    step = STRIDE if overlap else PASSAGE
    sizes = np.array([len(t) for t in texts], np.int64)
    blocks = -(-sizes // step)
    n = np.maximum(blocks - 1, np.minimum(blocks, 1)) if overlap else blocks  # passages of each text
    base = np.cumsum(n) - n
    total = int(n.sum())
    text = np.repeat(np.arange(len(texts)), n)
    start = (np.arange(total) - base[text]) * step
    token = np.concatenate(texts) if texts else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    block = (np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // step

    def rows(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The passages of the chosen words, and the words."""
        who, where, said = owner[use], block[use], token[use].astype(np.int64)
        own, prior = where < n[who], (where >= 1) & overlap
        return np.concatenate([(base[who] + where)[own], (base[who] + where - 1)[prior]]), np.concatenate([said[own], said[prior]])

    outside = np.bincount(rows(token < 0)[0], minlength=total)
    use = token >= 0
    use[use] = counts[token[use]]
    row, said = rows(use)
    key, count = np.unique(row * len(counts) + said, return_counts=True)
    return Passages(key // len(counts), key % len(counts), count, text, start, outside)


def weighted(p: Passages, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The passages with any weight, the first entry of each, and the entries' TF-IDF values, of length 1 by passage.

    A word outside the benchmark weighs as much as the median of those inside.
    """
    value = (1 + np.log(p.count)) * weight[p.column]
    starts = np.flatnonzero(np.append(True, p.row[1:] != p.row[:-1])) if len(p.row) else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, value
    rows = p.row[starts]
    usual = np.median(weight[weight > 0])
    norm = np.sqrt(np.add.reduceat(value**2, starts) + p.outside[rows] * usual**2)
    value = value / np.repeat(norm, np.diff(np.append(starts, len(value))))
    return rows, starts, value.astype(np.float32)


def project(p: Passages, weight: np.ndarray, basis: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages, entries' columns and values, starts, and the passages' coordinates in ``basis``.

    Passages whose part inside the benchmark is shorter than ``least`` are left out: no cosine is larger than that.
    """
    rows, starts, value = weighted(p, weight)
    column = p.column
    if least and len(starts):
        long = np.add.reduceat(value**2, starts) >= least**2
        keep = np.repeat(long, np.diff(np.append(starts, len(value))))
        rows, value, column = rows[long], value[keep], column[keep]
        sizes = np.diff(np.append(starts, len(keep)))[long]
        starts = np.cumsum(sizes) - sizes
    if not len(starts):
        return rows, column, value, starts, np.zeros((0, basis.shape[1]), np.float32)
    return rows, column, value, starts, np.add.reduceat(basis[column] * value[:, None], starts, axis=0)


def _texts(batches: Iterator[pa.RecordBatch], width: str) -> Iterator[list[np.ndarray]]:
    """Blocks of word numbers from the column ``tokens``."""
    held, size = [], 0
    for batch in batches:
        for x in batch.column(batch.schema.get_field_index("tokens")):
            held.append(np.frombuffer(x.as_py(), width).astype(np.int32))
            size += len(held[-1])
            if size >= BLOCK_WORDS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _table(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def document_frequencies(tokens: DataFrame, n_words: int, width: str) -> tuple[np.ndarray, int]:
    """In how many passages each word is, and how many passages there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(n_words, np.int64), 0
        for texts in _texts(batches, width):
            p = passages(texts, np.ones(n_words, bool), False)
            counts += np.bincount(p.column, minlength=n_words)
            total += len(p.text)
        there = np.flatnonzero(counts)
        yield _table([(-1, total), *zip(there.tolist(), counts[there].tolist(), strict=True)], ("word", pa.int64()), ("n", pa.int64()))

    rows = tokens.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a benchmark word
    df, total = np.zeros(n_words, np.int64), 0
    for r in rows:
        if r["word"] < 0:
            total = r["n"]
        else:
            df[r["word"]] = r["n"]
    return df, total


def gram_times(tokens: DataFrame, width: str, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A ``basis`` for the TF-IDF matrix A of all passages; added up by stripes of columns."""
    shared = tokens.sparkSession.sparkContext.broadcast((weight, basis.astype(np.float32)))
    shape = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, basis = shared.value
        total = np.zeros(shape, np.float64)
        for texts in _texts(batches, width):
            p = passages(texts, weight > 0, False)
            rows, column, value, starts, y = project(p, weight, basis)
            if len(rows):
                order = np.argsort(column, kind="stable")
                columns = column[order]
                heads = np.flatnonzero(np.append(True, columns[1:] != columns[:-1]))
                at = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(value))))
                total[columns[heads]] += np.add.reduceat(y[at[order]] * value[order, None], heads, axis=0)
        stripes = [(k, total[k::STRIPES].tobytes()) for k in range(STRIPES)]
        yield _table(stripes, ("stripe", pa.int64()), ("part", pa.binary()))

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table["part"])
        return pa.table({"stripe": table["stripe"][:1], "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(shape)
    parts = tokens.mapInArrow(run, "stripe long, part binary").groupBy("stripe").applyInArrow(added, "stripe long, part binary")
    for r in parts.toLocalIterator():
        out[r["stripe"] :: STRIPES] = np.frombuffer(r["part"]).reshape(-1, shape[1])
    return out


def singular_vectors(image: np.ndarray, mixture: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of A from ``image`` = A'A ``mixture``, by the Nystroem form: one pass over A is enough."""
    shift = 1e-9 * np.linalg.norm(image)
    if not shift:
        return mixture  # no passage has any word of the benchmark
    image = image + shift * mixture
    core = mixture.T @ image
    values, turn = np.linalg.eigh((core + core.T) / 2)
    root = image @ (turn / np.sqrt(np.maximum(values, shift)))
    return np.linalg.svd(root, full_matrices=False)[0]


def common(item: list[int], window: list[int]) -> int:
    """The length of the longest common subsequence, by bits of an integer."""
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in window:
        hit = row & at.get(w, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(item) - row.bit_count()


class Group:
    """Items whose windows take equally many blocks: ``before`` a passage's first one, and ``after`` it."""

    def __init__(self, items: Items, which: list[int], before: int, after: int, df: np.ndarray):
        self.which, self.before, self.after = np.array(which), before, after
        self.tokens = [items.tokens[k] for k in which]
        tokens = [np.array(t) for t in self.tokens]
        self.size = np.array([len(t) for t in tokens])
        free = [int(n * ASSUMED) for n in self.size]
        self.need = np.ceil(self.size * LIKELY - free - 1e-9)
        looked = [t[np.argsort(-df[t], kind="stable")[n:]] for t, n in zip(tokens, free, strict=True)]
        said, owner = np.concatenate(looked), np.repeat(np.arange(len(which)), [len(t) for t in looked])
        self.holders = owner[np.argsort(said, kind="stable")]  # by word; as often as the item says it
        self.count = np.bincount(said, minlength=len(df))
        self.first = np.cumsum(self.count) - self.count
        self.masks = None
        if self.size.max() <= 64:
            words_, place = np.unique(np.concatenate(tokens), return_inverse=True)
            self.place = np.full(len(df) + 1, len(words_))  # the last place is for words that no item has
            self.place[words_] = np.arange(len(words_))
            self.masks = np.zeros((len(which), len(words_) + 1), np.uint64)
            at = np.concatenate([np.arange(n) for n in self.size]).astype(np.uint64)
            np.bitwise_or.at(self.masks, (np.repeat(np.arange(len(which)), self.size), place), np.uint64(1) << at)

    def candidates(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, own item) of each passage whose window may have LIKELY of the item's words."""
        sizes = np.array([len(t) for t in texts], np.int64)
        blocks = -(-sizes // STRIDE)
        base = np.cumsum(blocks) - blocks
        token = np.concatenate(texts)
        block = np.repeat(base, sizes) + (np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // STRIDE
        use = token >= 0
        use[use] = self.count[token[use]] > 0
        key = np.unique(block[use] * len(self.count) + token[use])
        row, said = key // len(self.count), key % len(self.count)
        n = self.count[said]
        at = np.arange(n.sum()) + np.repeat(self.first[said] - (np.cumsum(n) - n), n)
        width, total = len(self.which), int(blocks.sum())
        held = np.zeros((total + 1, width), np.int32)
        np.cumsum(np.bincount(np.repeat(row, n) * width + self.holders[at], minlength=total * width).reshape(total, width), axis=0, out=held[1:])
        passages_ = np.maximum(blocks - 1, np.minimum(blocks, 1))
        text = np.repeat(np.arange(len(texts)), passages_)
        start = np.arange(len(text)) - np.repeat(np.cumsum(passages_) - passages_, passages_)
        low, high = base[text] + np.maximum(start - self.before, 0), base[text] + np.minimum(start + self.after, blocks[text])
        row, own = np.nonzero(held[high] - held[low] >= self.need)
        return text[row], start[row] * STRIDE, own

    def lcs(self, texts: list[np.ndarray], text: np.ndarray, start: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The longest common subsequences of items with their windows, as ``common``; many at a time if an item's words fit a number's bits."""
        if self.masks is None:
            return np.array([common(t, w.tolist()) for t, w in ((self.tokens[o], window(texts[x], s, len(self.tokens[o]))) for x, s, o in zip(text, start, own, strict=True))], np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        token, base = self.place[np.concatenate(texts)], np.cumsum(sizes) - sizes
        out = np.zeros(len(text), np.int64)
        for i in range(0, len(text), GROUP_PAIRS):
            x, s, o = (v[i : i + GROUP_PAIRS] for v in (text, start, own))
            n = self.size[o]
            low, high = base[x] + np.maximum(s - n // 2, 0), base[x] + np.minimum(s + np.maximum(PASSAGE, n) + n // 2, sizes[x])
            full = np.uint64(2**64 - 1) >> (64 - n).astype(np.uint64)
            row, flat, at, none = full.copy(), self.masks.ravel(), o * self.masks.shape[1], self.masks.shape[1] - 1
            for k in range(int((high - low).max())):
                said = np.where(low + k < high, token[np.minimum(low + k, len(token) - 1)], none)
                hit = row & flat[at + said]
                row = (row + hit | row - hit) & full
            out[i : i + GROUP_PAIRS] = n - np.bitwise_count(row)
        return out


def window(text: np.ndarray, start: int, n: int) -> np.ndarray:
    """The words that a passage's candidate of ``n`` words is aligned with."""
    return text[max(0, start - n // 2) : start + max(PASSAGE, n) + n // 2]


def grouped(items: Items, df: np.ndarray) -> list[Group]:
    by: dict[tuple[int, int], list[int]] = {}
    for k, t in enumerate(items.tokens):
        half = len(t) // 2
        by.setdefault((-(-half // STRIDE), -(-(max(PASSAGE, len(t)) + half) // STRIDE)), []).append(k)
    return [Group(items, which[i : i + GROUP_ITEMS], *reach, df) for reach, which in sorted(by.items()) for i in range(0, len(which), GROUP_ITEMS)]


class Searcher:
    """Holds texts against a block of items; ``df`` tells which words are frequent."""

    def __init__(self, items: Items, weight: np.ndarray, basis: np.ndarray, df: np.ndarray):
        self.items, self.weight, self.basis = items, weight, basis.astype(np.float32)
        none = np.zeros(0, np.int64)
        p = Passages(*_item_entries(items, weight), none, none, np.zeros(len(items.ids), np.int64))
        self.rows, _, _, _, y = project(p, weight, self.basis)
        self.latent = (y / np.maximum((y**2).sum(axis=1, keepdims=True), 1e-9)).T
        self.column = {int(k): i for i, k in enumerate(self.rows)}
        self.tokens = [np.array(t) for t in items.tokens]
        self.groups = grouped(items, df)

    def search(self, texts: list[np.ndarray]) -> list[list[tuple]]:
        """For each text the (item_id, cosine, lcs, answer) that pass, the best of each item."""
        out: list[dict] = [{} for _ in texts]
        p = passages(texts, self.weight > 0, True)
        rows, _, _, _, y = project(p, self.weight, self.basis, MIN_COSINE)
        there = np.zeros(len(self.weight) + 1, bool)  # the last place is for words outside
        for i in range(0, len(rows), 4096):
            cosine = y[i : i + 4096] @ self.latent
            for a, b in zip(*np.nonzero(cosine >= MIN_COSINE), strict=True):
                row, item = rows[i + a], int(self.rows[b])
                text, start = int(p.text[row]), int(p.start[row])
                said = window(texts[text], start, len(self.tokens[item]))
                there[said] = True
                most = there[self.tokens[item]].sum() / len(self.tokens[item])  # no common subsequence is longer
                there[said] = False
                if most >= LIKELY:
                    self._align(out[text], item, said, lambda a=a, b=b, cosine=cosine: float(cosine[a, b]))
        self._search_present(texts, p, out)
        return [[hits[k] for k in sorted(hits)] for hits in out]

    def _align(self, hits: dict, item: int, said: np.ndarray, cosine) -> None:
        """Puts the item into ``hits`` if it passes and is better than what is there."""
        tokens, said = self.items.tokens[item], said.tolist()
        lcs = common(tokens, said) / len(tokens)
        best = hits.get(item)
        if lcs < LIKELY or best and best[2] >= lcs:
            return
        tail = self.items.answers[item]
        answer = common(tokens[-tail:], said) / tail
        if lcs >= SURE or answer >= ANSWER:
            hits[item] = (self.items.ids[item], cosine(), lcs, answer)

    def _search_present(self, texts: list[np.ndarray], p: Passages, out: list[dict]) -> None:
        """Adds to ``out`` what passes by the words that are present, frequent ones too."""
        blocks = np.cumsum([-(-len(t) // STRIDE) for t in texts])
        first = 0
        while first < len(texts):
            upto = max(first + 1, int(np.searchsorted(blocks, (blocks[first - 1] if first else 0) + GROUP_BLOCKS, "right")))
            some = texts[first:upto]
            for g in self.groups if any(map(len, some)) else ():
                text, start, own = g.candidates(some)
                if len(text):
                    lcs = g.lcs(some, text, start, own)
                    for k in np.flatnonzero(lcs >= g.size[own] * LIKELY - 1e-9):
                        where, item, at = first + int(text[k]), int(g.which[own[k]]), int(start[k])
                        self._align(out[where], item, window(texts[where], at, int(g.size[own[k]])), lambda w=where, at=at, item=item: self._cosine(p, w, at, item))
            first = upto

    def _cosine(self, p: Passages, text: int, start: int, item: int) -> float:
        """The cosine of a passage with an item; 0 if either has no word that counts."""
        row = int(np.searchsorted(p.text, text)) + start // STRIDE
        low, high = np.searchsorted(p.row, [row, row + 1])
        if low == high or item not in self.column:
            return 0.0
        one = Passages(np.zeros(high - low, np.int64), p.column[low:high], p.count[low:high], p.text[row : row + 1], p.start[row : row + 1], p.outside[row : row + 1])
        return float(project(one, self.weight, self.basis)[4][0] @ self.latent[:, self.column[item]])


def _item_entries(items: Items, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pairs = [(k, w) for k, t in enumerate(items.tokens) for w in t if weight[w] > 0]
    key = np.array([k * len(weight) + w for k, w in pairs], np.int64)
    key, count = np.unique(key, return_counts=True)
    return key // len(weight), key % len(weight), count


def _block_hits(docs: DataFrame, text: str, tokens: str, items: Items, into: str, keep_text: bool) -> DataFrame:
    """``docs``, perhaps without ``text``, with the hits of one block of items appended to the array column ``into``; the words' numbers go to ``tokens`` meanwhile."""
    spark = docs.sparkSession
    n_words = len(items.vocabulary)
    width = "<i2" if n_words < 1 << 15 else "<i4"
    shared = spark.sparkContext.broadcast(items.vocabulary)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [numbered(t.as_py(), shared.value).astype(width).tobytes() for t in batch.column(batch.schema.get_field_index(text))]
            batch = batch.append_column(tokens, pa.array(made, pa.binary()))
            yield batch if keep_text else batch.drop_columns([text])

    out = T.StructType([f for f in docs.schema.fields if keep_text or f.name != text])
    rows = docs.mapInArrow(tokenise, T.StructType([*out.fields, T.StructField(tokens, T.BinaryType())]))
    rows = written(rows, "tokens")
    slim = rows.select(F.col(tokens).alias("tokens"))
    df, total = document_frequencies(slim, n_words, width)
    weight = np.where(df <= max(1.0, MAX_SHARE * total), np.log((total + 1) / (df + 0.5)), 0.0)
    weight = np.maximum(weight, 0.0)
    if not weight.any():
        weight = np.ones(n_words)  # a corpus so small that every word is in most passages
    at, columns, counts = _item_entries(items, weight)
    rng = np.random.default_rng(11)
    rank = min(RANK, n_words)
    mix = rng.normal(size=(len(items.ids), rank))
    start = np.zeros((n_words, rank))
    np.add.at(start, columns, ((1 + np.log(counts)) * weight[columns])[:, None] * mix[at])
    mixture = np.linalg.qr(start + 1e-6 * rng.normal(size=start.shape))[0]
    basis = singular_vectors(gram_times(slim, width, weight, mixture), mixture)
    model = spark.sparkContext.broadcast((items, weight, basis, df))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*model.value)
        for batch in batches:
            where = batch.schema.get_field_index(into)
            found = batch.column(where).to_pylist()
            held, first, size = [], 0, 0
            said = batch.column(batch.schema.get_field_index(tokens))
            for i, x in enumerate(said):
                held.append(np.frombuffer(x.as_py(), width).astype(np.int32))
                size += len(held[-1])
                if size >= BLOCK_WORDS or i + 1 == len(said):
                    for k, hits in enumerate(searcher.search(held)):
                        found[first + k] += [dict(zip(("item_id", "cosine", "lcs", "answer"), h, strict=True)) for h in hits]
                    held, first, size = [], i + 1, 0
            batch = batch.set_column(where, batch.schema.field(where), pa.array(found, batch.schema.field(where).type))
            yield batch.drop_columns([tokens])

    return rows.mapInArrow(search, out)


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", into: str = "hits", keep_text: bool = True) -> DataFrame:
    """``docs`` with the array column ``into``: the benchmark items found in each whole text.

    Without ``keep_text`` the text isn't carried along.  Rows and other columns stay, repeated rows too; a column already named ``into`` is
    replaced.  Null and empty texts have no hits, null and empty items are in no text; a
    null item_id stays null.  An empty benchmark or an empty table gives no hits.
    """
    kind = "array<struct<item_id:bigint,cosine:double,lcs:double,answer:double>>"
    out = docs.drop(*[c for c in docs.columns if c.lower() == into.lower()]).withColumn(into, F.array().cast(kind))
    (tokens,) = free(out, "__tokens")
    rows = ((r[0], r[1]) for r in benchmark.select(F.col(item_id).cast("long"), "text").toLocalIterator())
    found = (read_items(b) for b in iter(lambda: list(islice(rows, BLOCK_ITEMS)), []))
    found = (b for b in found if b.ids)
    block = next(found, None)
    if block is None:
        return out if keep_text else out.drop(text)
    while block is not None:  # the driver holds two blocks at most
        after = next(found, None)
        out = _block_hits(out, text, tokens, block, into, keep_text or after is not None)
        block = after
    return out


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item found in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    return hits.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


QUERIES = {"op5_latent_decontamination": op5_latent_decontamination}

"""Exact substring dedup: bytes of strings that an earlier document holds.

1. *Packs.*  Texts are packed, some megabytes a row, compressed, and written.
2. *Runs.*  Each string of ``LENGTH`` bytes has a least hash among its ``GRAM``-byte
   pieces; neighbouring strings with the same least hash form a run.  Equal
   strings have equal least hashes, so runs meet by that hash.  Equal runs are a
   class, told by 120 bits of hashes within a pack and 96 between packs; a pack
   sends one short entry a class, with the smallest document that holds it there.
   A class's first run stands for it: the others are settled, as an earlier
   document holds them.  First runs are compared by their bytes if their least
   hash has such runs in other documents.
3. *Intervals.*  For each bucket of runs to compare, suffixes are sorted by their
   first bytes and common prefixes are derived on the Burrows-Wheeler order by
   increasing value: an interval of the suffix array for a string w is split
   into those for cw by extending it backward by each word c of ``WORD`` bytes
   (fewer at last), breadth first, until w has ``LENGTH`` bytes.  What is left
   unsplit is one string; all its places in documents after its first are marked.
4. *Removal.*  Marks go back to their packs, which cut the bytes out, with those of
   settled runs as the comparison's senders have written them down.

Exchanged: packs twice (compressed), 12 bytes a class (about 0.7 x the text), and
the bytes of runs to compare, which are written first.  A least hash with many classes in one pack
(``LOCAL_HOT``), or over ``HOT`` to compare in all, sends its strings one by one instead, each once a pack,
dealt by their own hash; a pack with that many sends a single entry for them.  So
a passage which a third of the documents share, with other text around it in
each, gives a bucket some entries a pack and never an entry a document.  Tasks
hold one pack or one bucket; buckets are dealt evenly, and partitions grow in
number with the text up to ``MAX_PARTS``, beyond which a task has more buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written
from .suffixes import ranked, refine

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1  # pieces in a string
PACK_BYTES = 4 << 20
BLOCK_BYTES = 1 << 16  # of text hashed at once, so that its arrays stay in a core's cache
WORD = 8
COMPARED_BYTES = 1 << 17  # of runs of a bucket that are compared at once; more if one least hash has more
BUCKET_BYTES = 8 << 20  # of text whose runs one bucket gets
PART_BYTES = 16 << 20  # of text whose buckets one partition gets, up to
MAX_PARTS = 20_000
HOT = 20_000
LOCAL_HOT = 8, 256  # least and greatest number of classes of one least hash for which a pack sends a single entry,
HOT_ENTRIES = 4_000_000  # in between as many as keep all packs' entries for one least hash under this
NEVER = np.iinfo(np.int64).max  # stands for a null doc_id: no id is larger
SETTLED, COMPARE, COMPARE_EACH = 1, 2, 3
MANY = 0  # the content hash of the one entry for a pack's many classes

PACK = "docs binary, lengths binary, body binary, size long"
CONTENTS = "pack long, bucket long, runs binary, bytes binary, settled binary, lone binary"
CONTENTS_NAMES = [c.split()[0] for c in CONTENTS.split(", ")]
OWN = -1  # the bucket of what stays with its pack
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (ids, lengths, compressed bytes) from rows of (doc_id, text)."""
    ids, bodies, held = [], [], 0

    def flush() -> pa.RecordBatch:
        body = b"".join(bodies)
        lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
        columns = [np.array(ids, np.int64).tobytes(), lengths.tobytes(), zstandard.compress(body, 3)]
        return pa.RecordBatch.from_arrays(
            [*[pa.array([c], pa.binary()) for c in columns], pa.array([len(body)], pa.int64())], names=["docs", "lengths", "body", "size"]
        )

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            ids.append(NEVER if doc is None else doc)
            bodies.append(text.as_py() or b"")
            held += len(bodies[-1]) + 16
            if held >= PACK_BYTES:
                yield flush()
                ids, bodies, held = [], [], 0
    if ids:
        yield flush()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        with np.errstate(over="ignore"):
            out[1:] = np.multiply.accumulate(np.full(n - 1, base, np.uint64))
    return out


_BASE = 0x9E3779B97F4A7C15 | 1
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    size = 1 << max(20, int(n).bit_length())
    if size not in _cache:
        _cache.clear()
        _cache[size] = _powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))
    return _cache[size]


def _ordered(*keys: np.ndarray) -> np.ndarray:
    """The order by ``keys``, the first first; where the first is nearly unique, a single quick sort."""
    order = np.argsort(keys[0])
    there = keys[0][order]
    same = there[1:] == there[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(order) else order
    part = order[tied]
    order[tied] = part[np.lexsort([k[part] for k in reversed(keys)])]
    return order


class Runs:
    """The runs of a stretch of whole documents: first byte, strings, least hash, content hash, document."""

    def __init__(self, body: bytes, lengths: np.ndarray):
        n = len(body)
        text = body + bytes(64)
        loads = lambda at: np.ndarray((n,), "<u8", buffer=text, offset=at, strides=(1,))
        h = loads(0) * np.uint64(0x9E3779B97F4A7C15)
        for at in (8, GRAM - 8):
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h += loads(at)
        h = _mixed(h)
        least, width = h, 1
        while width * 2 <= SPAN:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        if width < SPAN:
            over = SPAN - width
            least = np.minimum(least[:-over], least[over:])
        starts = np.cumsum(lengths) - lengths
        fits = np.maximum(lengths - LENGTH + 1, 0)
        edge = np.zeros(n + 1, np.int8)
        edge[starts[fits > 0]] += 1
        np.subtract.at(edge, (starts + fits)[fits > 0], 1)
        at = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
        low = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        self.start = at[head]
        self.count = np.diff(np.append(head, len(at)))
        self.least = _mixed(low[head])
        up, _ = _tables(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=self.sums[1:])
        self.content = self.hashes(self.start, self.count)
        self.doc = np.searchsorted(starts + lengths, self.start, side="right")

    def hashes(self, start: np.ndarray, count: np.ndarray | int) -> np.ndarray:
        """A hash of the bytes of ``count`` strings from each start on."""
        return _mixed((self.sums[start + count - 1 + SPAN] - self.sums[start]) * _tables(len(self.sums) - 1)[1][start])


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Pack:
    """A pack's texts, their runs, and the classes of equal runs, in order of (least hash, content hash)."""

    def __init__(self, docs: bytes, lengths: bytes, body: bytes, local_hot: int):
        self.ids, self.sizes, self.raw = np.frombuffer(docs, np.int64), np.frombuffer(lengths, np.int64), zstandard.decompress(body)
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        self.blocks: list[tuple[int, Runs]] = []  # first byte
        firsts, first = [], 0
        while first < len(self.ids):
            begin = int(self.starts[first])
            last = max(first + 1, int(np.searchsorted(ends, begin + BLOCK_BYTES, side="right")))
            self.blocks.append((begin, Runs(self.raw[begin : int(ends[last - 1])], self.sizes[first:last])))
            firsts.append(first)
            first = last
        joined = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
        self.start = joined([r.start + at for at, r in self.blocks])
        self.count = joined([r.count for _, r in self.blocks])
        self.doc = joined([r.doc + k for k, (_, r) in zip(firsts, self.blocks, strict=True)])
        self.block = np.repeat(np.arange(len(self.blocks)), [len(r.start) for _, r in self.blocks])
        least, content = (np.concatenate([np.zeros(0, np.uint64), *[getattr(r, k) for _, r in self.blocks]]) for k in ("least", "content"))
        order = _ordered(least, content)
        least, content = least[order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (least[1:] != least[:-1]) | (content[1:] != content[:-1])
        heads = np.flatnonzero(new)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.least, self.content = least[heads], content[heads]
        id_ = self.ids[self.doc]
        self.first = np.minimum.reduceat(id_[order], heads) if len(heads) else id_
        self.leads = id_ == self.first[self.of]  # whether a run is of its class's first document
        # classes become entries: one each, or one for all of a least hash that has many
        new = np.ones(len(heads), bool)
        new[1:] = self.least[1:] != self.least[:-1]
        at = np.flatnonzero(new)
        many = np.diff(np.append(at, len(heads))) >= local_hot
        group = np.cumsum(new) - 1
        kept = new | ~many[group]
        self.entry = np.cumsum(kept) - 1
        self.entries = np.flatnonzero(kept)
        self.many = many[group][self.entries]

    def flags(self, verdicts: list | None, buckets: int) -> np.ndarray:
        """What is to be done with each run."""
        of_entry = np.zeros(len(self.entries), np.uint8)
        by = {int(v["bucket"]): np.frombuffer(v["flags"], np.uint8) for v in verdicts or ()}
        order, groups = _grouped(_bucket(self.least[self.entries], buckets))
        for b, at, end in groups:
            of_entry[order[at:end]] = by[b]
        return np.where(self.leads, of_entry[self.entry][self.of], SETTLED) if len(self.of) else np.zeros(0, np.uint8)

    def lone(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the strings that are compared each: their first bytes, their runs, their classes, and a hash of each; the first of a class leads.

        Strings are in order of class and document.
        """
        run = np.flatnonzero(flags == COMPARE_EACH)
        at, run = _spread(self.start[run], self.count[run]), np.repeat(run, self.count[run])
        key = np.zeros(len(at), np.uint64)
        for k in np.unique(self.block[run]):
            here = self.block[run] == k
            begin, runs = self.blocks[k]
            key[here] = runs.hashes(at[here] - begin, 1)
        least = self.least[self.of[run]]
        order = np.lexsort((self.ids[self.doc[run]], least, key))
        at, run, key, least = at[order], run[order], key[order], least[order]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (least[1:] != least[:-1])
        return at, run, np.cumsum(new) - 1, key


def _bucket(least: np.ndarray, buckets: int) -> np.ndarray:
    return ((least >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _grouped(to: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that puts equal buckets together, and (bucket, first, end) of each that is there."""
    order = np.argsort(to, kind="stable")
    there = to[order]
    heads = np.flatnonzero(np.append(True, there[1:] != there[:-1])) if len(to) else np.zeros(0, np.int64)
    return order, list(zip(there[heads].tolist(), heads.tolist(), np.append(heads[1:], len(to)).tolist(), strict=True)) if len(to) else []


def _cells(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def _entries(buckets: int, local_hot: int):
    """(pack, bucket, doc ids, entries of 12 bytes) for each pack and bucket with runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, docs, lengths, body in _cells(batch, "pack", "docs", "lengths", "body"):
                pack = Pack(docs, lengths, body, local_hot)
                least = pack.least[pack.entries]
                content = pack.content[pack.entries] & np.uint64((1 << 56) - 1)
                content = np.where(pack.many, np.uint64(MANY), np.maximum(content, np.uint64(MANY + 1)))
                order, groups = _grouped(_bucket(least, buckets))
                short = np.concatenate([least[order].view(np.uint8).reshape(-1, 8)[:, :5], content[order].view(np.uint8).reshape(-1, 8)[:, :7]], axis=1)
                doc = pack.first[pack.entries][order]
                rows = [(number, b, doc[at:end].tobytes(), short[at:end].tobytes()) for b, at, end in groups]
                if rows:
                    yield _batch(rows, ("pack", pa.int64()), ("bucket", pa.int64()), ("docs", pa.binary()), ("entries", pa.binary()))

    return run


def _batch(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _judge(table: pa.Table, hot: int) -> pa.Table:
    """For one bucket's entries, what is to be done with the first runs of each: (pack, bucket, a byte an entry)."""
    docs = [np.frombuffer(x.as_py(), np.int64) for x in table["docs"]]
    short = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, 12) for x in table["entries"]]
    sizes = np.array([len(d) for d in docs])
    doc, short = np.concatenate(docs), np.concatenate(short)
    wide = lambda part, n: np.concatenate([part, np.zeros((len(part), 8 - n), np.uint8)], axis=1).view("<u8")[:, 0]
    least, content = wide(short[:, :5], 5), wide(short[:, 5:], 7)
    order = _ordered(least, content, doc)
    least, content, doc = least[order], content[order], doc[order]
    n = np.arange(len(doc))
    new_least = np.ones(len(doc), bool)
    new_least[1:] = least[1:] != least[:-1]
    new = new_least.copy()
    new[1:] |= content[1:] != content[:-1]
    first = doc[np.maximum.accumulate(np.where(new, n, 0))]
    several = content == MANY
    settled = (doc > first) & ~several
    group, heads = np.cumsum(new_least) - 1, np.flatnonzero(new_least)
    lowest, highest = np.minimum.reduceat(first, heads), np.maximum.reduceat(first, heads)
    crowded = np.bincount(group, several, len(heads)) > 0
    todo = ~settled & ((lowest < highest) | crowded)[group]
    crowded |= np.bincount(group, todo, len(heads)) > hot
    out = np.zeros(len(doc), np.uint8)
    out[order] = np.where(settled, SETTLED, np.where(todo, np.where(crowded[group], COMPARE_EACH, COMPARE), 0))
    parts = np.split(out, np.cumsum(sizes)[:-1])
    return pa.table({"pack": table["pack"], "bucket": table["bucket"], "flags": pa.array([p.tobytes() for p in parts], pa.binary())})


def _joined(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (begin, end) of stretches, both rising, with those that touch made one."""
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    head = np.flatnonzero(new)
    return np.column_stack([begin[head], end[np.append(head[1:], len(begin)) - 1]]) if len(head) else np.zeros((0, 2), np.int64)


def _contents(buckets: int, local_hot: int):
    """CONTENTS from packs with verdicts.

    For each bucket: columns of the runs to compare, and their bytes.  For each pack, in bucket OWN: the stretches
    of settled runs, and (first byte, string, whether a smaller document in the pack has it) of the strings that are
    compared each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, docs, lengths, body, verdicts in _cells(batch, "pack", "docs", "lengths", "body", "verdicts"):
                pack = Pack(docs, lengths, body, local_hot)
                flags = pack.flags(verdicts, buckets)
                whole = np.flatnonzero(flags == COMPARE)
                place, of, string, key = pack.lone(flags)
                leads = _leads(string)
                at = np.concatenate([pack.start[whole], place[leads]])
                doc = pack.doc[np.concatenate([whole, of[leads]])]
                count = np.concatenate([pack.count[whole], np.ones(len(leads), np.int64)])
                to = np.concatenate([_bucket(pack.least[pack.of[whole]], buckets), _bucket(key[leads], buckets)])
                part = np.concatenate([pack.least[pack.of[whole]], key[leads]]) & np.uint64(0xFFFF)
                row = np.column_stack([pack.ids[doc], doc, at - pack.starts[doc], count, part.astype(np.int64)])
                order, groups = _grouped(to)
                pieces = [pack.raw[x : x + c + LENGTH - 1] for x, c in zip(at[order].tolist(), count[order].tolist(), strict=True)]
                rows = [(number, b, row[order[i:j]].tobytes(), b"".join(pieces[i:j]), None, None) for b, i, j in groups]
                done = np.flatnonzero(flags == SETTLED)
                settled = _joined(pack.start[done], pack.start[done] + pack.count[done] + LENGTH - 1)
                id_ = pack.ids[pack.doc[of]]
                lone = np.column_stack([place, string, id_ > id_[leads][string]]).astype(np.int64)
                rows.append((number, OWN, None, None, settled.tobytes(), lone.tobytes()))
                yield _batch(rows, *((n, t) for n, t in zip(CONTENTS_NAMES, (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)))

    return run


def _leads(string: np.ndarray) -> np.ndarray:
    """The first place of each of the numbers, which rise."""
    return np.flatnonzero(np.append(True, string[1:] != string[:-1])) if len(string) else np.zeros(0, np.int64)


def string_classes(body: bytes, length: int) -> np.ndarray:
    """For each place of ``body``, the number of the string of ``length`` bytes there; equal strings, equal numbers.

    Suffixes are sorted by their first bytes.  ``split[k]`` says whether the suffixes of ranks k - 1 and k differ in
    their first l bytes.  The interval of a string w of l bytes is extended backward to those of cw, where c has
    ``WORD`` bytes: neighbours that begin with the same c stay together just if the suffixes after it lie in one
    interval of l.  l grows by c a round, over what is unsplit yet, and stops at ``length``.  Zeros follow the end.
    """
    n = len(body)
    text = body + bytes(16)
    keys = np.ndarray((n,), ">u8", buffer=text, strides=(1,)).astype(np.uint64)
    rank, todo = ranked(keys)
    step = WORD
    while len(todo) and step < length:
        rank, todo = refine(rank, step, todo)
        step *= 2
    order = np.argsort(rank)
    place = np.full(n + WORD, n)  # the empty suffix stands alone
    place[order] = np.arange(n)
    split = np.ones(n + 1, bool)
    split[1:n] = keys[order[1:]] != keys[order[:-1]]
    left = np.flatnonzero(~split[:n])
    for l in range(WORD, length, WORD):  # noqa: E741
        c = min(WORD, length - l)
        interval = np.cumsum(split)
        now = interval[place[order[left - 1] + c]] != interval[place[order[left] + c]]
        split[left[now]] = True
        left = left[~now]
        if not len(left):
            break
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(split[:n]) - 1
    return out


def _compared(table: pa.Table) -> pa.Table:
    """(pack, marks): stretches of documents, as (document in pack, first byte, end), that an earlier document holds.

    Runs that can have equal strings are of one part; parts are compared COMPARED_BYTES or so at once.
    """
    rows = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, 5) for x in table["runs"]])
    pack = np.repeat(table["pack"].to_numpy(), [len(x.as_py()) // 40 for x in table["runs"]])
    body = b"".join(x.as_py() for x in table["bytes"])
    order = np.argsort(rows[:, 4])
    sizes = rows[:, 3] + LENGTH - 1
    offset = (np.cumsum(sizes) - sizes)[order]
    rows, pack, sizes = rows[order], pack[order], sizes[order]
    heads = np.flatnonzero(np.append(True, rows[1:, 4] != rows[:-1, 4]))
    chunk = (np.cumsum(sizes) - sizes)[heads] // COMPARED_BYTES
    cuts = [*heads[np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))].tolist(), len(rows)]
    owner, marks = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
    for first, end in zip(cuts[:-1], cuts[1:], strict=True):
        here = slice(first, end)
        run, found = _later(rows[here], b"".join(body[x : x + n] for x, n in zip(offset[here].tolist(), sizes[here].tolist(), strict=True)))
        owner.append(pack[here][run])
        marks.append(found)
    owner, marks = np.concatenate(owner), np.concatenate(marks)
    order, groups = _grouped(owner)
    by = [(p, marks[order[i:j]].tobytes()) for p, i, j in groups]
    return pa.table({"pack": pa.array([p for p, _ in by], pa.int64()), "marks": pa.array([m for _, m in by], pa.binary())})


def _later(rows: np.ndarray, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The runs, and their stretches, that an earlier document of ``rows`` holds."""
    ids, doc, at, count, _ = rows.T
    sizes = count + LENGTH - 1
    offset = np.cumsum(sizes) - sizes
    string = string_classes(body, LENGTH)[_spread(offset, count)]
    run, shift = np.repeat(np.arange(len(count)), count), _spread(np.zeros(len(count), np.int64), count)
    first = np.full(int(string.max()) + 1 if len(string) else 0, NEVER)
    np.minimum.at(first, string, ids[run])
    later = ids[run] > first[string]
    run, shift = run[later], shift[later]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (shift[1:] != shift[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(run)) - 1
    run, begin = run[head], shift[head]
    return run, np.column_stack([doc[run], at[run] + begin, at[run] + shift[last] + LENGTH]) if len(head) else np.zeros((0, 3), np.int64)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """OUT rows from packs with their stretches of settled runs, strings compared each, and marks."""
    for batch in batches:
        for docs, lengths, body, settled, lone, marks in _cells(batch, "docs", "lengths", "body", "settled", "lone", "marks"):
            ids, sizes, raw = np.frombuffer(docs, np.int64), np.frombuffer(lengths, np.int64), zstandard.decompress(body)
            starts = np.cumsum(sizes) - sizes
            marked = np.concatenate([np.frombuffer(m, np.int64).reshape(-1, 3) for m in marks or ()] or [np.zeros((0, 3), np.int64)])
            begin, end = starts[marked[:, 0]] + marked[:, 1], starts[marked[:, 0]] + marked[:, 2]
            done = np.frombuffer(settled, np.int64).reshape(-1, 2)
            at, string, later = np.frombuffer(lone, np.int64).reshape(-1, 3).T
            each = at[np.isin(at[_leads(string)], begin)[string] | (later > 0)]
            n = len(raw)
            places = lambda *parts, n=n: np.bincount(np.concatenate(parts), minlength=n + 1).astype(np.int32)
            edge = places(done[:, 0], begin, each)
            edge -= places(done[:, 1], end, each + LENGTH)
            gone = np.cumsum(edge[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            full = starts[sizes > 0]
            begins[full] = gone[full]
            removed, spans = _per_doc(gone, full, sizes), _per_doc(begins, full, sizes)
            stay = sizes - removed
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            ends = np.cumsum(stay)
            yield _batch(
                [
                    (None if i == NEVER else i, s, g, k, kept[e - w : e])
                    for i, s, g, k, e, w in zip(ids.tolist(), sizes.tolist(), removed.tolist(), spans.tolist(), ends.tolist(), stay.tolist(), strict=True)
                ],
                ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()),
            )


def _per_doc(x: np.ndarray, full: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes), np.int64)
    if len(full):
        out[sizes > 0] = np.add.reduceat(x, full, dtype=np.int64)
    return out


def _each_bucket(rows: DataFrame, parts: int, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f`` of all rows of each bucket; partitions have equally many buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch.column(batch.schema.get_field_index("bucket")).to_numpy()
            heads = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            for at, end in zip([0, *heads.tolist()], [*heads.tolist(), len(bucket)], strict=True):
                if held and end > at and held[-1].column(held[-1].schema.get_field_index("bucket"))[0].as_py() != bucket[at]:
                    yield from f(pa.Table.from_batches(held)).to_batches()
                    held = []
                if end > at:
                    held.append(batch.slice(at, end - at))
        if held:
            yield from f(pa.Table.from_batches(held)).to_batches()

    dealt = rows.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("bucket").mapInArrow(run, schema)


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """OUT for each row of ``df``: what is kept of the text's bytes, and counts.

    A byte goes if a string of LENGTH bytes that covers it also starts in a
    document with a smaller id, judged on the texts as given.  Null texts are
    empty; a null id counts as larger than all others, and rows with equal ids
    (repeated rows, null ids) take nothing from each other.  Other columns are
    not read, whatever their names.  No rows give an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    packs = written(rows.mapInArrow(_packed, PACK).withColumn("pack", F.monotonically_increasing_id()), "packs")
    size, n = packs.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    local_hot = min(LOCAL_HOT[1], max(LOCAL_HOT[0], HOT_ENTRIES // max(n, 1)))
    parts = min(MAX_PARTS, max(2 * spark.sparkContext.defaultParallelism, -(-size // PART_BYTES)))
    buckets = parts * max(1, -(-size // (parts * BUCKET_BYTES)))
    entries = packs.mapInArrow(_entries(buckets, local_hot), "pack long, bucket long, docs binary, entries binary")
    judged = _each_bucket(entries, parts, lambda t: _judge(t, hot), "pack long, bucket long, flags binary")
    verdicts = judged.groupBy("pack").agg(F.collect_list(F.struct("bucket", "flags")).alias("verdicts"))
    with_verdicts = packs.join(written(verdicts, "verdicts"), "pack", "left")
    contents = written(with_verdicts.mapInArrow(_contents(buckets, local_hot), CONTENTS), "contents")
    compared = _each_bucket(contents.where(F.col("bucket") != OWN).select("pack", "bucket", "runs", "bytes"), parts, _compared, "pack long, marks binary")
    marks = compared.groupBy("pack").agg(F.collect_list("marks").alias("marks"))
    own = contents.where(F.col("bucket") == OWN).select("pack", "settled", "lone")
    return packs.join(own, "pack").join(written(marks, "marks"), "pack", "left").mapInArrow(_removed, OUT)


def op9_bwt_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the digest of what is left of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_bwt_substrings": op9_bwt_substrings}

ORACLES = {
    "op9_bwt_substrings": """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, 9223372036854775807) AS id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT row, id, unnest(range(length(h) // 2 - 49)) AS i, unnest(list_transform(range(length(h) // 2 - 49), lambda i: md5(substr(h, 2 * i + 1, 100)))) AS s
  FROM d WHERE length(h) >= 100
), marked AS (
  SELECT row, i, id > min(id) OVER (PARTITION BY s) AS later FROM strings
), bytes AS (
  SELECT p.row, p.i, p.b, max(coalesce(m.later, false)) OVER (PARTITION BY p.row ORDER BY p.i ROWS 49 PRECEDING) AS gone
  FROM (SELECT row, unnest(range(length(h) // 2)) AS i, unnest(regexp_extract_all(h, '..')) AS b FROM d) p LEFT JOIN marked m ON m.row = p.row AND m.i = p.i
), runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY row ORDER BY i), false) AS begins FROM bytes
), each AS (
  SELECT row, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM runs GROUP BY row
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN each USING (row)
"""
}

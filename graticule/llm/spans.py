"""Long exact spans shared between records (problem 10), and the fuzzy passages around them.

Every window of ``length`` characters is assigned to one of its k-mers, the leftmost of the least hash (its seed), so
two equal windows have equal seeds at equal places. The work goes on seeds, about one in 44 characters:

1. a scan counts in how many documents each seed hash stands (combinable: minimum and maximum id, number);
2. a second scan takes the places of seeds that stand in several documents, with the text of the windows that belong to
   the place (at most 2 * length - k characters). Places with the same text within one block of a map task prove each
   other: their windows are reported at once and one of them goes on, so a text that stands in a third of all documents
   leaves each task once;
3. the places of one seed meet in one partition, where the hashes of their windows are compared; windows of two or more
   documents are shared. Seeds in more than ``HOT`` places don't meet: their windows' hashes are spread over all
   partitions instead, again at most one per block.

These steps emit nothing per pair of documents. The seeds of several documents are broadcast if there are at most ``KNOWN`` of
them (32 MB), else they are joined to the documents' seeds.

Chaining (``passages``) uses seeds of shorter windows as anchors. All places of a seed are joined with all its places in
other documents, the anchors of a pair of documents are chained in order with gap costs through a Fenwick tree, and each
chain is aligned to give a passage with its similarity. It finds reworded copies that have an equal run of 5/4 k characters,
and gives a row per couple of documents, so a text in n documents gives n * (n - 1) rows; ``shared_spans``, which gives
the exact coverage, compares windows as above.

Defined cases: null texts and texts shorter than the length have no spans; equal texts under two ids share everything;
the positions count code points; a repeat within one document doesn't count; rows with a null id are one document;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.session import checkpointed

LENGTH, K = 150, 64
KNOWN = 4_000_000
HOT = 50_000
#: Rows of a seed or of a class of equal texts that one task of ``passages`` joins with.
SALT = 500
#: Characters of a block of texts that is hashed at once, and places of a block that are compared at once.
BLOCK, PLACES = 1 << 21, 200_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
U = np.uint64


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, U), np.full(n, INVERSE, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def _prefix(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the code points, along the last axis."""
    terms = _mix(codes.astype(U) + U(77)) * powers[: codes.shape[-1]]
    out = np.zeros((*codes.shape[:-1], codes.shape[-1] + 1), U)
    np.cumsum(terms, axis=-1, out=out[..., 1:])
    return out


def _hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, down: np.ndarray) -> np.ndarray:
    return _mix((prefix[end] - prefix[start]) * down[start])


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n, done = len(x) - w + 1, 1
    while done * 2 <= w:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:n], x[w - done : w - done + n])


def places(texts: list[str | None], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one seed: number of the text, first and last window, place of the seed, hashes of seed and run."""
    kept = [(i, t) for i, t in enumerate(texts) if t is not None and len(t) >= length]
    if not kept:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U, U))
    codes = np.frombuffer("".join(t for _, t in kept).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for _, t in kept])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    up, down = _powers(1 << int(len(codes)).bit_length())
    prefix = _prefix(codes, up)
    at = np.arange(len(codes) - k + 1)
    seeds = _mix((prefix[k:] - prefix[:-k]) * down[: len(at)])
    bits = U(int(len(codes)).bit_length())
    least = _least((seeds >> bits << bits) | at.astype(U), length - k + 1) & ((U(1) << bits) - U(1))
    valid = np.ones(len(codes), bool)
    for e in [*starts[1:], len(codes)]:  # windows may not cross the end of a text
        valid[e - length + 1 : e] = False
    windows = np.flatnonzero(valid)
    seat = least[windows].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (seat[1:] != seat[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(windows)]]) - 1
    lo, hi, seat = windows[first], windows[last], seat[first]
    text = np.searchsorted(starts, lo, "right") - 1
    run = _mix(_hashes(prefix, lo, hi + length, down) + U(1000003) * (seat - lo).astype(U) + (hi - lo).astype(U))
    base = starts[text]
    return np.array([i for i, _ in kept])[text], lo - base, hi - base, seat - base, seeds[seat], run


def _blocks(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[list, list, list]]:
    """(ids, texts, further columns) of about BLOCK characters."""
    ids, texts, rest, n = [], [], [[] for _ in more], 0
    for b in batches:
        for at in range(0, len(b), 500):
            part = b.slice(at, 500)
            columns = [part.column(i).to_pylist() for i in range(2 + len(more))]
            for row in zip(*columns):
                ids.append(row[0])
                texts.append(row[1])
                for x, y in zip(rest, row[2:]):
                    x.append(y)
                n += len(row[1] or "")
                if n >= BLOCK:
                    yield ids, texts, rest
                    ids, texts, rest, n = [], [], [[] for _ in more], 0
    if ids:
        yield ids, texts, rest


def _ids(values: list, kind: pa.DataType, at: np.ndarray) -> pa.Array:
    return pa.array(values, kind).take(pa.array(at))


def document_seeds(df: DataFrame, key: str, text: str, length: int, k: int) -> DataFrame:
    """(_seed, id): each document's seeds, once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for ids, texts, _ in _blocks(_typed(batches, box := [])):
            kind = box[0]
            which, _, _, _, seed, _ = places(texts, length, k)
            order = np.lexsort((which, seed))
            seed, which = seed[order], which[order]
            new = np.ones(len(seed), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (which[1:] != which[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(seed[new].view(np.int64)), _ids(ids, kind, which[new])], names=["_seed", "_id"])

    return df.select(key, text).mapInArrow(rows, f"_seed bigint, _id {dict(df.dtypes)[key]}")


def _typed(batches: Iterator[pa.RecordBatch], box: list) -> Iterator[pa.RecordBatch]:
    for b in batches:
        box[:] = [b.schema.field(0).type]
        yield b


def common_seeds(df: DataFrame, key: str, text: str, length: int, k: int) -> DataFrame:
    """(_seed, _n, _first, _second): the seed hashes of several documents, their number and two of the documents."""
    seeds = document_seeds(df, key, text, length, k)
    one = F.struct("_id")
    return seeds.groupBy("_seed").agg(F.count("*").alias("_n"), F.min(one).alias("_first"), F.max(one).alias("_second")).filter("_first != _second").select("_seed", "_n", F.col("_first._id").alias("_first"), F.col("_second._id").alias("_second"))


def _context_rows(df: DataFrame, key: str, text: str, common: DataFrame, length: int, k: int) -> DataFrame:
    """Rows of kind 0 (covered runs), 1 (places with their texts) and 2 (hashes of single windows of hot seeds)."""
    kind = dict(df.dtypes)[key]
    sc = df.sparkSession.sparkContext
    schema = f"_kind int, _key bigint, _id {kind}, _many boolean, _lo int, _hi int, _seat int, _text string"
    few = common.select("_seed", (F.col("_n") > HOT).alias("_hot")).limit(KNOWN + 1)
    known = few.toArrow()  # at most KNOWN + 1 numbers
    small = known.num_rows <= KNOWN
    if small:
        order = np.argsort(known.column(0).to_numpy())
        shared = sc.broadcast((known.column(0).to_numpy()[order], known.column(1).to_numpy(zero_copy_only=False)[order]))
        source, extra = df.select(key, text), ()
    else:
        # too many to broadcast: each document gets its own common seeds by a join
        own = document_seeds(df, key, text, length, k).join(common.select("_seed", (F.col("_n") > HOT).alias("_hot")), "_seed")
        own = own.groupBy("_id").agg(F.collect_list("_seed").alias("_seeds"), F.collect_list("_hot").alias("_hots"))
        source, extra = df.select(key, text).join(own, F.col(key).eqNullSafe(F.col("_id"))).select(key, text, "_seeds", "_hots"), ("_seeds", "_hots")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, rest in _blocks(_typed(batches, box := []), *extra):
            which, lo, hi, seat, seed, run = places(texts, length, k)
            if not len(which):
                continue
            key_ = seed.view(np.int64)
            if small:
                names, hots = shared.value
            else:
                flat = dict(x for s, h in zip(*rest) for x in zip(s, h))
                names = np.sort(np.fromiter(flat, np.int64, len(flat)))
                hots = np.array([flat[x] for x in names.tolist()], bool)
            if not len(names):
                continue
            found = np.minimum(np.searchsorted(names, key_), len(names) - 1)
            mine = np.flatnonzero(names[found] == key_)
            if not len(mine):
                continue
            hot = hots[found[mine]]
            which, lo, hi, seat, run, key_ = which[mine], lo[mine], hi[mine], seat[mine], run[mine], key_[mine]
            at = {}
            same = np.array([at.setdefault(x, i) for i, x in enumerate(ids)])  # rows of one id are one document
            # places of the same seed with the same text prove each other if they stand in two documents
            order = np.lexsort((run, key_))
            new = np.concatenate([[True], (key_[order][1:] != key_[order][:-1]) | (run[order][1:] != run[order][:-1])])
            group = np.cumsum(new) - 1
            lead = order[np.flatnonzero(new)]
            many = np.zeros(len(lead), bool)
            np.logical_or.at(many, group, same[which[order]] != same[which[lead]][group])
            done = order[many[group]]
            # of texts that are proven one place goes on; of others all, as a document may hold its text twice
            on = np.sort(np.concatenate([lead[many], order[~many[group]]]))
            sure = np.zeros(len(which), bool)
            sure[lead[many]] = True
            yield _made(box[0], ids, 0, key_[done], which[done], np.ones(len(done), bool), lo[done], hi[done], seat[done], None)
            a = on[~hot[on]]
            yield _made(box[0], ids, 1, key_[a], which[a], sure[a], lo[a], hi[a], seat[a], [texts[w][i : j + length] for w, i, j in zip(which[a], lo[a], hi[a])])
            b = on[hot[on]]
            if len(b):
                yield from _window_rows(box[0], ids, texts, same, which[b], lo[b], hi[b], sure[b], length)

    return source.mapInArrow(rows, schema)


def _made(kind, ids, what, key_, which, many, lo, hi, seat, text) -> pa.RecordBatch:
    n = len(key_)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, what, np.int32)), pa.array(key_), _ids(ids, kind, which), pa.array(many), *[pa.array(x.astype(np.int32)) for x in (lo, hi, seat)], pa.array(text if text is not None else [None] * n, pa.string())],
        names=["_kind", "_key", "_id", "_many", "_lo", "_hi", "_seat", "_text"],
    )


def _window_rows(kind, ids, texts, same, which, lo, hi, many, length) -> Iterator[pa.RecordBatch]:
    """The windows of hot seeds, one row per hash: those of two documents of the block are marked and reported."""
    out = [_windows(texts[w][i : j + length], int(j - i) + 1, length) for w, i, j in zip(which, lo, hi)]
    sizes = np.array([len(x) for x in out])
    row = np.repeat(np.arange(len(out)), sizes)
    hashes = np.concatenate(out).view(np.int64)
    start = lo[row] + (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    doc, sure = which[row], many[row]
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
    group = np.cumsum(new) - 1
    lead = order[np.flatnonzero(new)]
    multi = np.zeros(len(lead), bool)
    np.logical_or.at(multi, group, (same[doc[order]] != same[doc[lead]][group]) | sure[order])
    done, rest = order[multi[group]], order[~multi[group]]
    on, proven = np.concatenate([lead[multi], rest]), np.arange(int(multi.sum()) + len(rest)) < int(multi.sum())
    yield _made(kind, ids, 0, hashes[done], doc[done], np.ones(len(done), bool), start[done], start[done], start[done], None)
    yield _made(kind, ids, 2, hashes[on], doc[on], proven, start[on], start[on], start[on], None)


def _windows(text: str, n: int, length: int) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    up, down = _powers(1 << max(9, int(len(codes)).bit_length()))
    prefix = _prefix(codes, up)
    at = np.arange(n)
    return _hashes(prefix, at, at + length, down)


def _meet(length: int):
    """Compares the windows of the places of each seed; a partition's rows come sorted by seed."""

    def compare(seed, lo, seat, hi, many, row_texts):
        n = len(seed)
        widths = hi - lo + 1
        size = int(widths.max()) + length - 1
        codes = np.zeros((n, size), np.uint32)
        for i, t in enumerate(row_texts):
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            codes[i, : len(c)] = c
        up, down = _powers(512 if size < 512 else 1 << size.bit_length())
        prefix = _prefix(codes, up)
        w = size - length + 1
        hashes = _mix((prefix[:, length:] - prefix[:, :-length]) * down[:w])
        row, at = np.nonzero(np.arange(w) < widths[:, None])
        start = lo[row] + at
        key = _mix(_mix(seed[row].view(U)) ^ hashes[row, at] ^ (U(0x51ED27) * (seat[row] - start).astype(U)))
        return row, start, key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            carry = t if carry is None else pa.concat_tables([carry, t])
            if carry.num_rows >= PLACES:
                seeds, kinds = carry.column("_key").to_numpy(), carry.column("_kind").to_numpy()
                cut = int(np.argmax((seeds == seeds[-1]) & (kinds == kinds[-1])))  # the last seed may go on
                if cut:
                    yield from split(carry.slice(0, cut))
                    carry = carry.slice(cut)
        if carry is not None and carry.num_rows:
            yield from split(carry)

    def split(t: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = np.searchsorted(t.column("_kind").to_numpy(), [1, 2])
        if a:
            yield spans(t.slice(0, a), np.arange(a))
        if b > a:
            yield from resolve(t.slice(a, b - a))
        if len(t) > b:
            yield from windows(t.slice(b))

    def spans(t: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        end = t.column("_hi").to_numpy()[at] + length
        return pa.RecordBatch.from_arrays([t.column("_id").combine_chunks().take(pa.array(at)), pa.array(t.column("_lo").to_numpy()[at]), pa.array(end.astype(np.int32))], names=["_id", "_s", "_e"])

    def windows(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Of a hash each block sends one row, or those of one document: a group is bounded by the number of blocks."""
        key, many = t.column("_key").to_numpy(), t.column("_many").to_numpy(zero_copy_only=False).astype(bool)
        doc = t.column("_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        multi = np.zeros(int(new.sum()), bool)
        np.logical_or.at(multi, group, (doc != doc[np.flatnonzero(new)][group]) | many)
        yield spans(t, np.flatnonzero(multi[group] & ~many))

    def resolve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        seed, lo, hi, seat = (t.column(c).to_numpy() for c in ("_key", "_lo", "_hi", "_seat"))
        many = t.column("_many").to_numpy(zero_copy_only=False).astype(bool)
        ids = t.column("_id").combine_chunks()
        doc = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        texts = t.column("_text").to_pylist()
        edges = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1], [True]]))
        sizes = np.diff(edges)
        lone = np.repeat((sizes == 1), sizes)  # nobody to compare with
        rows = np.flatnonzero(~lone)
        step = 20_000
        begin = 0
        while begin < len(rows):
            end = min(len(rows), begin + step)
            while end < len(rows) and seed[rows[end]] == seed[rows[end - 1]]:
                end += 1
            r = rows[begin:end]
            begin = end
            row, start, key = compare(seed[r], lo[r], seat[r], hi[r], many[r], [texts[i] for i in r])
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            group = np.cumsum(new) - 1
            lead = order[np.flatnonzero(new)]
            multi = np.zeros(len(lead), bool)
            d = doc[r][row]
            np.logical_or.at(multi, group, (d[order] != d[lead][group]) | many[r][row][order])
            hit = np.zeros(len(row), bool)
            hit[order] = multi[group]
            hit &= ~many[r][row]  # these are reported already
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            first = np.concatenate([[True], (row[at][1:] != row[at][:-1]) | (start[at][1:] != start[at][:-1] + 1)])
            a = np.flatnonzero(first)
            z = np.concatenate([a[1:], [len(at)]]) - 1
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(r[row[at[a]]])), pa.array(start[at[a]].astype(np.int32)), pa.array((start[at[z]] + length).astype(np.int32))], names=["_id", "_s", "_e"])

    return run


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """(key, start_pos, end_pos): the maximal runs of characters in spans of at least ``length`` that another document has too."""
    if not 1 <= k <= length:
        raise ValueError("k must be between 1 and the length")
    kind = dict(df.dtypes)[key]
    common = common_seeds(df, key, text, length, k)
    rows = _context_rows(df, key, text, common, length, k)
    # one shuffle: covered runs by document, places by seed, windows of hot seeds by hash
    moved = rows.repartition(F.col("_kind"), F.when(F.col("_kind") == 0, F.xxhash64("_id")).otherwise(F.col("_key"))).sortWithinPartitions("_kind", "_key")
    return merged(moved.mapInArrow(_meet(length), f"_id {kind}, _s int, _e int"), key)


def merged(spans: DataFrame, key: str) -> DataFrame:
    """Overlapping and touching spans of a document as one."""
    order = Window.partitionBy("_id").orderBy("_s", "_e")
    before = spans.withColumn("_until", F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    island = before.withColumn("_g", F.sum(F.when(F.col("_s") <= F.col("_until"), 0).otherwise(1)).over(order))
    return island.groupBy("_id", "_g").agg(F.min("_s").alias("start_pos"), F.max("_e").alias("end_pos")).select(F.col("_id").alias(key), "start_pos", "end_pos")


def coverage(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_chars, shared_chars, share): how much of every document stands in others."""
    spans = shared_spans(df, key, text, length).groupBy(key).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    all_ = df.select(key, F.coalesce(F.char_length(text), F.lit(0)).alias("n_chars"))
    out = all_.join(spans, key, "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("bigint")))
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))


def shared_places(df: DataFrame, key: str, text: str, length: int, k: int) -> DataFrame:
    """(_seed, _id, _pos, _n): every place of the seeds that stand in several rows, and their number of rows."""
    common = document_seeds(df, key, text, length, k).groupBy("_seed").agg(F.count("*").alias("_n")).filter("_n > 1")
    known = common.limit(KNOWN + 1).toArrow()  # at most KNOWN + 1 rows of two numbers
    small = known.num_rows <= KNOWN
    if small:
        order = np.argsort(known.column(0).to_numpy())
        shared = df.sparkSession.sparkContext.broadcast(tuple(known.column(i).to_numpy()[order] for i in (0, 1)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in _blocks(_typed(batches, box := [])):
            which, _, _, seat, seed, _ = places(texts, length, k)
            order = np.lexsort((seat, which))
            which, seat, seed = which[order], seat[order], seed[order].view(np.int64)
            on = np.ones(len(which), bool)
            on[1:] = (which[1:] != which[:-1]) | (seat[1:] != seat[:-1])
            n = np.zeros(len(which), np.int64)
            if small:
                names, counts = shared.value
                if not len(names):
                    continue
                found = np.minimum(np.searchsorted(names, seed), len(names) - 1)
                on &= names[found] == seed
                n = counts[found]
            yield pa.RecordBatch.from_arrays([pa.array(seed[on]), _ids(ids, box[0], which[on]), pa.array(seat[on].astype(np.int32)), pa.array(n[on])], names=["_seed", "_id", "_pos", "_n"])

    at = df.select(key, text).mapInArrow(rows, f"_seed bigint, _id {dict(df.dtypes)[key]}, _pos int, _n bigint")
    return at if small else at.drop("_n").join(common, "_seed")


class Fenwick:
    """Prefix maxima over ranks, with the item that has the maximum."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, at: int, value: float, item: int) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at][0]:
                self.best[at] = (value, item)
            at += at & -at

    def before(self, at: int) -> tuple[float, int]:
        out = (float("-inf"), -1)
        while at > 0:
            if self.best[at][0] > out[0]:
                out = self.best[at]
            at -= at & -at
        return out


GAP = 0.25


def chains(anchors: list[tuple[int, int]], k: int = K, gap: float = GAP) -> list[list[tuple[int, int]]]:
    """Collinear chains of anchors (place here, place there), the best first; each anchor is in one chain.

    A chain's score is k per anchor less ``gap`` per character by which neighbours are apart on both sides (beyond k); the
    best predecessor of an anchor is a prefix maximum of score + gap * (x + y) over smaller places there.
    """
    items = sorted(set(anchors))
    ranks = {y: i for i, y in enumerate(sorted({y for _, y in items}))}
    tree, score, back = Fenwick(len(ranks)), [0.0] * len(items), [-1] * len(items)
    i = 0
    while i < len(items):
        j = i
        while j < len(items) and items[j][0] == items[i][0]:  # equal places here can't follow each other
            x, y = items[j]
            value, item = tree.before(ranks[y])
            linked = value - gap * (x + y - 2 * k) if item >= 0 else float("-inf")
            score[j], back[j] = (k + linked, item) if linked > 0 else (float(k), -1)
            j += 1
        for h in range(i, j):
            tree.put(ranks[items[h][1]], score[h] + gap * (items[h][0] + items[h][1]), h)
        i = j
    used, out = [False] * len(items), []
    for end in sorted(range(len(items)), key=lambda h: (-score[h], h)):
        chain, h = [], end
        while h >= 0 and not used[h]:
            used[h] = True
            chain.append(items[h])
            h = back[h]
        if chain:
            out.append(chain[::-1])
    return out


def align(a: str, b: str, chain: list[tuple[int, int]], k: int = K) -> tuple[int, int, int, int, float]:
    """(start, end, start there, end there, similarity) of a chain: gaps between its anchors aligned, its ends extended."""
    x0, y0 = chain[0]
    while x0 and y0 and a[x0 - 1] == b[y0 - 1]:
        x0, y0 = x0 - 1, y0 - 1
    x1, y1 = chain[-1][0] + k, chain[-1][1] + k
    while x1 < len(a) and y1 < len(b) and a[x1] == b[y1]:
        x1, y1 = x1 + 1, y1 + 1
    same, px, py = chain[0][0] - x0 + x1 - chain[-1][0], chain[0][0], chain[0][1]
    for x, y in chain[1:]:
        if a[px:x] == b[py:y]:
            same += x - px
        else:
            same += sum(m.size for m in SequenceMatcher(None, a[px:x], b[py:y]).get_matching_blocks())
        px, py = x, y
    return x0, x1, y0, y1, min(1.0, 2 * same / max(1, x1 - x0 + y1 - y0))


def matches(a: str, b: str, anchors: list[tuple[int, int]], length: int, k: int, similarity: float) -> Iterator[tuple[int, int, int, int, float]]:
    """The passages of two texts; a chain that is too unlike is parted at its widest gap."""
    todo = chains(anchors, k)
    while todo:
        chain = todo.pop()
        found = align(a, b, chain, k)
        if found[4] >= similarity:
            if found[1] - found[0] >= length:
                yield found
        elif len(chain) > 1:
            cut = max(range(1, len(chain)), key=lambda i: chain[i][0] - chain[i - 1][0] + chain[i][1] - chain[i - 1][1])
            todo += [chain[:cut], chain[cut:]]


def _salted(n: str) -> Column:
    """The number of parts into which what has ``n`` rows is dealt."""
    return (F.col(n) / SALT).cast("int") + 1


def passages(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K, similarity: float = 0.8) -> DataFrame:
    """(key, other, start_pos, end_pos, other_start, other_end, similarity): fuzzy passages of at least ``length`` characters.

    Every two documents with a common seed are chained from all places of their seeds. The seeds are those of windows of
    5/4 k, so that each equal run of that length gives an anchor. Equal texts are chained once, as one class, and the
    passages go to all members; seeds and classes with many rows are dealt to several tasks.
    """
    kind = dict(df.dtypes)[key]
    rows_ = df.filter(F.char_length(text) >= length).select(F.md5(F.col(text)).alias("_class"), F.col(key).alias("_doc"), F.col(text).alias("_text"))
    members = checkpointed(rows_.groupBy("_class", "_doc").agg(F.lit(1).alias("_one")).select("_class", "_doc"))
    classes = members.groupBy("_class").agg(F.count("*").alias("_copies"))
    at = shared_places(rows_, "_class", "_text", min(length, k + k // 4), k)
    at = checkpointed(at.groupBy("_seed", "_id").agg(F.collect_set("_pos").alias("_here"), F.max("_n").alias("_n")))
    here = at.withColumn("_part", F.explode(F.sequence(F.lit(0), _salted("_n") - 1)))
    there = at.select("_seed", F.col("_id").alias("_other"), F.col("_here").alias("_there"), F.pmod(F.xxhash64("_id"), _salted("_n")).cast("int").alias("_part"))
    pairs = here.join(there, ["_seed", "_part"]).join(classes.filter("_copies > 1").select(F.col("_class").alias("_id"), F.lit(True).alias("_several")), "_id", "left")
    pairs = pairs.filter((F.col("_id") != F.col("_other")) | F.col("_several")).groupBy("_id", "_other").agg(F.collect_list(F.struct("_here", "_there")).alias("_anchors"))
    texts = rows_.join(at.select(F.col("_id").alias("_class")).distinct(), "_class", "left_semi").groupBy("_class").agg(F.first("_text").alias("_text"))
    both = pairs.join(texts.toDF("_id", "_a"), "_id").join(texts.toDF("_other", "_b"), "_other").select("_id", "_other", "_anchors", "_a", "_b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, out = [], []
            for i in range(len(batch)):
                anchors, a, b = (batch.column(j)[i].as_py() for j in (2, 3, 4))
                for found in matches(a, b, [(x, y) for p in anchors for x in p["_here"] for y in p["_there"]], length, k, similarity):
                    which.append(i)
                    out.append(found)
            take = pa.array(which, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *[pa.array([o[j] for o in out], pa.int32()) for j in range(4)], pa.array([o[4] for o in out], pa.float64())], names=["_id", "_other", "start_pos", "end_pos", "other_start", "other_end", "similarity"])

    found = both.mapInArrow(rows, "_id string, _other string, start_pos int, end_pos int, other_start int, other_end int, similarity double")
    dealt = members.join(classes, "_class").select("_class", "_doc", _salted("_copies").alias("_parts"), F.pmod(F.xxhash64("_doc"), _salted("_copies")).cast("int").alias("_part"))
    parts = classes.select("_class", F.sequence(F.lit(0), _salted("_copies") - 1).alias("_all"))
    for side, name in (("_id", "_key"), ("_other", "_with")):
        found = found.join(parts.withColumnRenamed("_class", side), side).withColumn("_part", F.explode("_all")).drop("_all")
        found = found.join(dealt.select(F.col("_class").alias(side), "_part", F.col("_doc").alias(name)), [side, "_part"]).drop("_part")
    return found.filter(~F.col("_key").eqNullSafe(F.col("_with"))).select(F.col("_key").cast(kind).alias(key), F.col("_with").alias("other"), "start_pos", "end_pos", "other_start", "other_end", "similarity")

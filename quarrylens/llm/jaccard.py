"""N-gram Jaccard join by signature trees: exact links of documents whose 5-word shingle sets have similarity >= 0.75.

1. Each distinct shingle set gets an id (a 64-bit hash of the set), its size and a bitmap of about BITS bits a shingle.
2. Which sets can meet: two similar sets share a shingle among the first quarter of each in any fixed order. Sets
   that share such a shingle make a list; lists with the same smallest id are joined to one. The order puts shingles last that several documents
   of a sample hold, the most common ones at the end, which keeps unrelated sets out of the lists; the result is the same under any order.
   What is dealt out for it are 40 bits of shingles and ids: sets that agree in these alone meet once more than needed.
3. A signature tree stands over each list (side by side in numpy arrays, so that a task works on thousands of lists at once). Its
   nodes hold the OR of their members' bitmaps, their size range and group range; a dual traversal drops node pairs whose largest possible
   overlap is too small, whose sizes differ too much, or which lie in one group. Every pair left is verified on the full sets.
4. So that large groups of near copies don't give all their pairs, the first traversal hands on only a spanning forest of the pairs
   it finds, those with the most common bits; the links found make groups, and a second one, over lists that had more pairs and still span several groups, hands on all pairs between these.
Links of both rounds together give the components. Nothing is capped: long lists are cut into blocks of BLOCK members
in order of size, and every pair of blocks whose sizes allow a link is visited.
Sets with one 64-bit id are taken as equal: among a billion distinct sets some pair collides with chance 0.03. Collisions of
shingles within two sets are as unlikely. Two similar sets with the same 40 bits of their ids (one pair in 10**12) miss lists of these two alone.

Defined cases: null, empty or blank text has no shingle and links with nothing (n_shingles 0, component its own id);
fewer than five words make one shingle; equal texts link; rows with a repeated id are documents of their own, each with
its own row; a row with a null id takes part and has a null component only if it is linked to null ids alone.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarrylens.llm.common import arrow_rows, connected_components, materialise, release, releasing, sliced, small_or_plain, table

WORDS, NUM, DEN = 5, 3, 4  # shingle length; similarity >= NUM / DEN
BITS = 4
BLOCK = 4096
FAN_OUT = 8
#: Rows of lists that a partition takes up at a time (and more only for one pair of blocks).
STREAM_ROWS = 8192
#: Pairs that are held to drop repeated ones before they are handed on.
STREAM_PAIRS = 100_000
#: Documents sampled for the shingle order: one in SHARE, of small tables SAMPLE. A sample that grows with the table keeps the lists as short on large ones.
SAMPLE, SHARE = 4000, 16
#: Shingles of two or more sampled documents that are put last, at most; the number in a sample of SAMPLE from which one counts as frequent.
LATE, FREQUENT = 1 << 19, 12
#: Sets whose shingles one bucket of the candidate search holds on average.
BUCKET_DOCS = 2000
#: Steps in which the place of a shingle in its set's order is kept (a prefix is a quarter of them, 256 at most).
PLACES = 1020
#: Sets of this size or more count as this large where their shingles are dealt out, and as having partners.
LARGE = 65535

U = np.uint64
KEY = (1 << 40) - 1  # the bits of an id that are dealt out
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping)."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
STEP = U(0x9E3779B97F4A7C15 | 1)
STEP_BACK = U(pow(int(STEP), -1, 1 << 64))
PLACE = mix(np.arange(11, 11 + WORDS, dtype=np.uint64)) | U(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**k and STEP**-k for k < n (wrapping), kept between calls."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        for name, base in (("up", STEP), ("down", STEP_BACK)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each UTF-8 text."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) < 400_000):
            total += len(texts[j]) + 1
            j += 1
        out += _sets_of(texts[i:j])
        i = j
    return out


def _sets_of(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = SPACE[data]
    edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=np.int8(1)))
    starts, stops = edge[0::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.cumsum(BYTE_CODE[LOWER[data]] * up[: len(data)], dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], U(0))
    words = mix((sums[stops - 1] - before) * down[starts] + (stops - starts).astype(np.uint64))
    n_words = np.searchsorted(starts, ends)
    n = len(words) - WORDS + 1
    grams = mix(sum((words[k : k + n] * PLACE[k] for k in range(WORDS)), np.zeros(n, np.uint64))) if n > 0 else np.zeros(0, np.uint64)
    out, a = [], 0
    for b in n_words:
        if b - a >= WORDS:
            s = np.sort(grams[a : b - WORDS + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            h = mix(np.array([np.sum(words[a:b] * PLACE[: b - a], dtype=np.uint64) + U(int(b - a))], np.uint64))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out


def set_id(s: np.ndarray) -> int:
    return int(mix(np.array([np.sum(mix(s), dtype=np.uint64) + U(len(s))], np.uint64)).view(np.int64)[0])


def bitmap(s: np.ndarray) -> np.ndarray:
    """Packed bitmap of a set: a power of two of bits, at least 64 and BITS for each shingle."""
    width = 1 << max(6, int(BITS * len(s) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(s & U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, sid, n, low, bits) of each row: id, size, smallest hash in another order and bitmap of its set; sid is null where the set is empty."""

    def run(batches):
        for b in sliced(batches):
            sets = shingle_sets(utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(mix(s ^ MIX1).min().view(np.int64)) if len(s) else None for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "sid", "n", "low", "bits"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), "doc_id long, sid long, n long, low long, bits binary")


def pack(x: np.ndarray, size: int = 5) -> np.ndarray:
    """The low bytes of each 64-bit number as a row."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :size]


def unpack(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view(np.uint64)[:, 0]


def top(s: np.ndarray) -> np.ndarray:
    """The upper 40 bits of shingles, in the same order; the lower ones choose the bucket."""
    return s >> U(24)


def bucket_of(s: np.ndarray, spread, buckets: int) -> np.ndarray:
    return (((s & U(0xFFFFFF)) + spread) % U(buckets)).astype(np.int64)


def cut(to: np.ndarray, rows: np.ndarray) -> list[pa.Array]:
    """The buckets of to and the bytes of the rows for each."""
    order = np.argsort(to, kind="stable")
    to, rows = to[order], rows[order]
    cuts = np.flatnonzero(np.diff(to, prepend=-1))
    stops = np.append(cuts[1:], len(to))[: len(cuts)]
    return [pa.array(to[cuts], pa.int64()), pa.array([rows[a:z].tobytes() for a, z in zip(cuts, stops, strict=True)], pa.binary())]


def common_shingles(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(late, rank, frequent): top bits of shingles in several sampled documents, the number of these up to the frequent ones', and the frequent ones.

    They only shape the order and the dealing, so any sample does, and so do the LATE most common ones.
    """
    share = max(1, min(SHARE, n_docs // SAMPLE))
    often = max(FREQUENT, FREQUENT * n_docs // share // SAMPLE)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_docs // share // BUCKET_DOCS)
    most = -(-LATE // buckets)

    def deal(batches):
        for b in sliced(batches):
            s = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(utf8(b.column(0)))])
            yield pa.RecordBatch.from_arrays(cut(bucket_of(s, U(0), buckets), pack(top(s))), names=["bucket", "grams"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        s, c = np.unique(unpack(np.frombuffer(b"".join(pdf["grams"]), np.uint8).reshape(-1, 5)), return_counts=True)
        at = np.flatnonzero(c > 1)
        at = at[np.argsort(-c[at], kind="stable")[:most]]
        out = pd.DataFrame({"late": [s[at].tobytes()], "count": [np.minimum(c[at], often).astype(np.int64).tobytes()]})
        release()
        return out

    rows = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select("text").mapInArrow(releasing(deal), "bucket long, grams binary")
    rows = rows.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(count, "late binary, count binary").collect()
    late = np.frombuffer(b"".join(r["late"] for r in rows), np.uint64)
    rank = np.frombuffer(b"".join(r["count"] for r in rows), np.int64)
    order = np.lexsort((-rank, late))
    late, rank = late[order], rank[order]
    new = np.concatenate(([True], late[1:] != late[:-1])) if len(late) else np.zeros(0, bool)
    late, rank = late[new], rank[new]
    return late, rank, late[rank >= often]


def is_in(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is among the ordered ones."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values if len(ordered) else np.zeros(len(values), bool)


def prefix(s: np.ndarray, late: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order; two similar sets share one of them."""
    n = len(s) - -(-len(s) * NUM // DEN) + 1
    if len(late):
        bits = top(s)
        at = np.minimum(np.searchsorted(late, bits), len(late) - 1)
        own = np.where(late[at] == bits, rank[at], 0)
        if own.any():
            s = s[np.argsort(own, kind="stable")]
    return s[:n]


def partnered(grams: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which entries of shingle lists (in order of grams) have another of their list that they may be similar to.

    Two similar sets meet under their first common shingle, and there the overlap is at most what is left of either from that place on:
    with r left of n a partner has at most r * (NUM + DEN) / NUM - n shingles, and any partner has at least n * NUM / DEN.
    """
    most = np.floor((n - place * n / PLACES) * (NUM + DEN) / NUM - n + 1e-6).astype(np.int64)
    least = -(-n * NUM // DEN)
    row = np.cumsum(np.concatenate(([0], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
    key = np.sort((row << 32) + n)
    found = np.searchsorted(key, (row << 32) + np.maximum(most, least - 1), "right") - np.searchsorted(key, (row << 32) + least)
    return (found - (n <= most) > 0) | (n >= LARGE)


def meeting_lists(docs: DataFrame, n_docs: int) -> DataFrame:
    """(list, key): sets (by the KEY bits of their ids) that share a prefix shingle with others, under the smallest key among them.

    The lists of shingles with one smallest key are joined to one: it holds all their pairs, and each pair in few lists.

    Shingles go to buckets of bounded size; the sets of a frequent shingle are spread over all buckets and meet as rows. An entry takes
    13 bytes: shingle and key, size, place.
    """
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(common_shingles(docs, n_docs))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_docs // BUCKET_DOCS)

    def deal(batches):
        late, rank, frequent = common.value
        for b in sliced(batches, 4096):
            own: dict[int, np.ndarray] = {}
            for s in shingle_sets(utf8(b.column(0))):
                if len(s):
                    own.setdefault(set_id(s), (len(s), prefix(s, late, rank)))
            if not own:
                continue
            sizes = [len(p) for _, p in own.values()]
            grams = np.concatenate([p for _, p in own.values()])
            sids, n = np.repeat(np.array(list(own), np.int64).view(np.uint64), sizes), np.repeat(np.array([n for n, _ in own.values()], np.int64), sizes)
            place = (np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) * PLACES // n
            spread = np.where(is_in(frequent, top(grams)), sids >> U(20), U(0))
            entries = np.concatenate((pack(top(grams)), pack(sids), pack(np.minimum(n, LARGE), 2), pack(place, 1)), axis=1)
            yield pa.RecordBatch.from_arrays(cut(bucket_of(grams, spread, buckets), entries), names=["bucket", "entries"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        frequent = common.value[2]
        entries = np.frombuffer(b"".join(pdf["entries"]), np.uint8).reshape(-1, 13)
        grams, keys = unpack(entries[:, :5]), unpack(entries[:, 5:10]).view(np.int64)
        n, place = unpack(entries[:, 10:12]).astype(np.int64), entries[:, 12]
        order = np.lexsort((keys, grams))
        grams, keys, n, place = grams[order], keys[order], n[order], place[order]
        new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (keys[1:] != keys[:-1]) | (n[1:] != n[:-1])))
        grams, keys, n, place = grams[new], keys[new], n[new], place[new]
        keep = is_in(frequent, grams)
        keep |= partnered(grams, n, place)
        grams, keys = grams[keep], keys[keep]
        cuts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(cuts, len(grams)))
        spread = np.repeat(is_in(frequent, grams[cuts]), sizes)
        lead = np.repeat(keys[cuts], sizes)  # the smallest, as they are sorted
        plain = ~spread & np.repeat(sizes > 1, sizes)
        rows = pd.DataFrame({"list": lead[plain], "key": keys[plain], "hot": False}).drop_duplicates()
        release()
        return pd.concat((rows, pd.DataFrame({"list": grams[spread].view(np.int64), "key": keys[spread], "hot": True})))

    dealt = docs.select("text").mapInArrow(releasing(deal), "bucket long, entries binary")
    lists = materialise(dealt.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(meet, "list long, key long, hot boolean"), "lists")
    hot = lists.where("hot").select(F.col("list").alias("gram"), "key")
    lead = hot.groupBy("gram").agg(F.min("key").alias("list"), F.count(F.lit(1)).alias("m")).where("m > 1")
    hot = hot.join(small_or_plain(materialise(lead, "leads")), "gram")  # no more rows than the driver sent out as frequent
    return lists.where("not hot").select("list", "key").unionByName(hot.select("list", "key")).distinct()


def overlap_needed(n1, n2):
    """The smallest overlap of sets of these sizes that reaches the similarity: NUM / (NUM + DEN) of both sizes."""
    return -(-(n1 + n2) * NUM // (NUM + DEN))


def possible(bits1, n1, room1, bits2, n2, room2) -> np.ndarray:
    """Whether sets of at least these sizes can overlap enough: common bits, and shingles that share a bit."""
    common = np.bitwise_count(bits1 & bits2).sum(axis=1, dtype=np.int64)
    return common + np.minimum(room1, room2) >= overlap_needed(n1, n2)


class Forest:
    """Signature trees side by side: a node holds the OR of its members' bitmaps, their size and group ranges and their room.

    Members stand in order of tree. levels[0] are the members, levels[-1] has one node a tree; kids[d] are the edges of the
    nodes of level d + 1 in level d.
    """

    def __init__(self, tree: np.ndarray, bits: np.ndarray, n: np.ndarray, group: np.ndarray):
        room = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels, self.kids = [(bits, n, n, room, group, group)], []
        while True:
            new = np.flatnonzero(np.diff(tree, prepend=tree[0] - 1))
            if len(new) == len(tree):
                return
            size = np.diff(np.append(new, len(tree)))
            rank = np.arange(len(tree)) - np.repeat(new, size)
            cuts = np.flatnonzero(rank % FAN_OUT == 0)
            b, lo, hi, r, g, h = self.levels[-1]
            self.kids.append(np.append(cuts, len(tree)))
            self.levels.append((np.bitwise_or.reduceat(b, cuts, axis=0), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.maximum.reduceat(r, cuts), np.minimum.reduceat(g, cuts), np.maximum.reduceat(h, cuts)))
            tree = tree[cuts]


def fits(level: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether members of nodes x and y can be similar and lie in different groups."""
    bits, lo, hi, room, g, h = level
    ok = (DEN * hi[y] >= NUM * lo[x]) & (DEN * hi[x] >= NUM * lo[y]) & ((g[x] != h[x]) | (g[y] != h[y]) | (g[x] != g[y]))
    at = np.flatnonzero(ok)
    ok[at] = possible(bits[x[at]], lo[x[at]], room[x[at]], bits[y[at]], lo[y[at]], room[y[at]])
    return ok


def traverse(forest: Forest, left: np.ndarray, right: np.ndarray):
    """Member pairs (i, j) of different groups below the root pairs (left, right) that may be similar; below a tree and itself i < j."""
    chunk = min(8000, max(200, 400_000 // forest.levels[0][0].shape[1]))  # a pair has up to FAN_OUT ** 2 pairs of children
    todo = [(len(forest.levels) - 1, left[k : k + chunk], right[k : k + chunk]) for k in range(0, len(left), chunk)]
    while todo:
        d, x, y = todo.pop()
        ok = fits(forest.levels[d], x, y)
        x, y = x[ok], y[ok]
        if not d:
            if len(x):
                yield x, y
            continue
        cuts = forest.kids[d - 1]
        nx, ny = cuts[x + 1] - cuts[x], cuts[y + 1] - cuts[y]
        n = nx * ny
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(ny, n)
        i, j = np.repeat(cuts[x], n) + at // wide, np.repeat(cuts[y], n) + at % wide
        same = np.repeat(x == y, n)
        ok = ~same | (i < j if d == 1 else i <= j)
        i, j = i[ok], j[ok]
        todo += [(d - 1, i[k : k + chunk], j[k : k + chunk]) for k in range(0, len(i), chunk)]


def spanning(i: np.ndarray, j: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """Numbers of the pairs of a heaviest spanning forest over m members: each round every tree takes its heaviest pair to another."""
    order = np.argsort(-weight, kind="stable")
    i, j = i[order], j[order]
    root, taken, open_ = np.arange(m), [], np.arange(len(i))
    while len(open_):
        best = np.full(m, len(i))
        np.minimum.at(best, root[i[open_]], open_)
        np.minimum.at(best, root[j[open_]], open_)
        new = np.unique(best[best < len(i)])
        taken.append(new)
        while True:
            x, y = root[i[new]], root[j[new]]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        open_ = open_[root[i[open_]] != root[j[open_]]]
    return order[np.concatenate(taken)] if taken else order


def forest_pairs(forest: Forest, left: np.ndarray, right: np.ndarray, left_over: np.ndarray):
    """Of traverse's pairs a heaviest spanning forest, by the share of common bits; left_over marks members with pairs that are not in it."""
    bits, m = forest.levels[0][0], len(forest.levels[0][1])
    held, n = [], 0
    for pair in chain(traverse(forest, left, right), [None]):
        if pair is not None:
            i, j = pair
            both = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
            held.append((i, j, both / np.bitwise_count(bits[i] | bits[j]).sum(axis=1, dtype=np.int64)))
            n += len(i)
        if n > STREAM_PAIRS or (pair is None and n):
            i, j, w = (np.concatenate(x) for x in zip(*held, strict=True))
            keep = spanning(i, j, w, m)
            left_over[np.delete(i, keep)] = True
            held, n = [(i[keep], j[keep], w[keep])], 0
    for i, j, _ in held:
        yield i, j


def list_pairs(cols: dict, near: bool, more: np.ndarray):
    """(a, b) of set ids that may be similar and lie in different groups, of whole lists (or pairs of their blocks).

    cols: key (number of the list or pair of blocks), two (whether it has two blocks), side, sid, n, low, grp, bits (a list
    of bytes). A tree stands over each bitmap width of each side, with the bitmaps of twice the width folded in.
    near: only a spanning forest of them, else everything; more marks the rows whose list has pairs that were held back.
    """
    words = np.array([len(x) for x in cols["bits"]]) // 8
    group = np.unique(cols["grp"], return_inverse=True)[1]
    for w in np.unique(words):
        at = np.flatnonzero((words == w) | (words == 2 * w))
        own = words[at] == w
        bits = np.empty((len(at), w), np.uint64)
        bits[own] = np.frombuffer(b"".join([cols["bits"][i] for i in at[own]]), np.uint64).reshape(-1, w)
        bits[~own] = np.bitwise_or.reduce(np.frombuffer(b"".join([cols["bits"][i] for i in at[~own]]), np.uint64).reshape(-1, 2, w), axis=1)
        tree = cols["key"][at] * 2 + cols["side"][at]
        order = np.lexsort((cols["n"][at], cols["low"][at] if near else group[at], tree))
        at, own, bits, tree = at[order], own[order], bits[order], tree[order]
        forest = Forest(tree, bits, cols["n"][at], group[at])
        roots, first = np.unique(tree, return_index=True)
        two = cols["two"][at[first]]
        both = np.flatnonzero(two[1:] & (roots[1:] == roots[:-1] + 1) & (roots[:-1] % 2 == 0))
        left = np.append(np.flatnonzero(~two), both)
        right, left_over = np.append(left[: len(left) - len(both)], both + 1), np.zeros(len(at), bool)
        found = forest_pairs(forest, left, right, left_over) if near else traverse(forest, left, right)
        for i, j in found:
            ok = own[i] | own[j]  # two folded members meet at their own width
            a, b = cols["sid"][at[i[ok]]], cols["sid"][at[j[ok]]]
            yield np.minimum(a, b), np.maximum(a, b)
        more[at[left_over]] = True


def proposals(rows: DataFrame, near: bool) -> DataFrame:
    """(a, b, null) pairs and (null, null, more) lists with pairs held back, by list_pairs over rows of in_blocks: each partition streams its sorted lists and works on whole lists of some thousand rows at a time."""
    names = ["list", "b1", "b2", "blk", "sid", "n", "low", "grp", "bits"]

    def work(t: pa.Table):
        of = {c: t.column(c).to_numpy() for c in names[:-1]}
        new = np.ones(t.num_rows, bool)
        new[1:] = (of["list"][1:] != of["list"][:-1]) | (of["b1"][1:] != of["b1"][:-1]) | (of["b2"][1:] != of["b2"][:-1])
        cols = of | {"key": np.cumsum(new), "two": of["b1"] != of["b2"], "side": (of["blk"] != of["b1"]).astype(np.int64), "bits": t.column("bits").to_pylist()}
        held, n, more = [], 0, np.zeros(t.num_rows, bool)
        for ab in chain(list_pairs(cols, near, more), [None]):
            if ab is not None:
                held.append(np.stack(ab, axis=1))
                n += len(held[-1])
            if n >= STREAM_PAIRS or (ab is None and n):
                found = np.unique(np.concatenate(held), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.nulls(len(found), pa.int64())], names=["a", "b", "more"])
                held, n = [], 0
        lists = np.unique(of["list"][more])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(lists), pa.int64()), pa.nulls(len(lists), pa.int64()), pa.array(lists)], names=["a", "b", "more"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < STREAM_ROWS:
                continue
            t = pa.Table.from_batches(held)
            last = np.array([t.column(c)[n - 1].as_py() for c in names[:3]])
            keys = np.stack([t.column(c).to_numpy() for c in names[:3]], axis=1)
            stop = int(np.argmax((keys == last).all(axis=1)))  # sorted: the last list may go on in the next batch
            if stop:
                yield from work(t.slice(0, stop))
            held, n = t.slice(stop).combine_chunks().to_batches(), n - stop
        if n:
            yield from work(pa.Table.from_batches(held))

    dealt = rows.select(names).repartition("list", "b1", "b2").sortWithinPartitions("list", "b1", "b2")
    return dealt.mapInArrow(releasing(run), "a long, b long, more long").distinct()


def in_blocks(lists: DataFrame, sets: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Members of lists with their bitmaps, under (list, b1, b2).

    A list of more than BLOCK members is cut into blocks in order of size; its members come once for each pair of blocks
    whose sizes allow a link. Only at the end the bitmaps of those sets that are members join them; bitmaps may hold a set several times.
    """
    count = lists.groupBy("list").agg(F.count(F.lit(1)).alias("m")).where(f"m > {BLOCK}").select(F.col("list").alias("long_list"))
    rows = lists.join(small_or_plain(materialise(count, "long")), F.col("list") == F.col("long_list"), "left").join(sets, "sid")
    short = rows.where("long_list is null").select("list", F.lit(0).cast("long").alias("b1"), F.lit(0).cast("long").alias("b2"), F.lit(0).cast("long").alias("blk"), "sid", "n", "low", "grp")
    long = rows.where("long_list is not null")
    sizes = long.groupBy("list", "n").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy("list").orderBy("n"))  # a row for each size of a list
    sizes = sizes.withColumn("upto", upto).selectExpr("list", "n", f"(upto - m) div {BLOCK} as first", f"(upto - 1) div {BLOCK} as last")
    sizes = materialise(sizes, "sizes")
    span = sizes.select("list", "n", F.explode(F.sequence("first", "last")).alias("blk")).groupBy("list", "blk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    span = materialise(span, "spans")
    x, y = span.alias("x"), span.alias("y")
    meets = (F.col("x.list") == F.col("y.list")) & (F.col("x.blk") <= F.col("y.blk")) & (F.col("y.lo") * NUM <= F.col("x.hi") * DEN)
    pairs = x.join(y, meets).select(F.col("x.list").alias("of"), F.col("x.blk").alias("b1"), F.col("y.blk").alias("b2"))
    pairs = pairs.select("of", "b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("blk"))
    long = long.join(sizes, ["list", "n"]).withColumn("blk", F.col("first") + F.pmod(F.xxhash64("sid"), F.col("last") - F.col("first") + 1)).drop("first", "last")
    long = long.join(pairs, (F.col("list") == F.col("of")) & (long["blk"] == pairs["blk"])).select("list", "b1", "b2", long["blk"], "sid", "n", "low", "grp")
    rows = materialise(short.unionByName(long), "blocks")
    members = materialise(rows.select("sid").distinct(), "members")
    return rows.join(bitmaps.join(small_or_plain(members), "sid", "left_semi").dropDuplicates(["sid"]), "sid")


def verify(pairs: DataFrame, docs: DataFrame, owners: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids whose full sets are similar. owners: (sid, doc_id), one document of each set."""
    need = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    need = materialise(owners.join(need, "sid").select("sid", F.col("doc_id").alias("own_id")), "need")

    def load(batches):
        for b in sliced(batches):
            own = [(k, s) for k, s in zip(b.column(0).to_pylist(), shingle_sets(utf8(b.column(1))), strict=True) if len(s) and set_id(s) == k]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int64()), pa.array([s.tobytes() for _, s in own], pa.binary())], names=["sid", "grams"])

    rows = docs.select("doc_id", "text").join(small_or_plain(need), F.col("doc_id").eqNullSafe(F.col("own_id"))).select("sid", "text")
    sets = materialise(rows.mapInArrow(releasing(load), "sid long, grams binary"), "sets")
    if sets.count() > need.count():  # an id is repeated with its text
        sets = materialise(sets.dropDuplicates(["sid"]), "sets")

    def similar(batches):
        for b in sliced(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((s, t))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(DEN * common >= NUM * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], names=["a", "b"])

    joined = pairs.join(sets.select(F.col("sid").alias("b"), F.col("grams").alias("grams_b")), "b").join(sets.select(F.col("sid").alias("a"), F.col("grams").alias("grams_a")), "a")
    return joined.select("a", "b", "grams_a", "grams_b").mapInArrow(releasing(similar), "a long, b long")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs. All Arrow tasks have run when it returns."""
    with arrow_rows(docs.sparkSession):
        return _components(docs)


def _components(docs: DataFrame) -> DataFrame:
    found = materialise(digests(docs), "digests")
    n_docs = found.count()
    sets = found.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("low").alias("low"))
    sets = materialise(sets, "distinct")
    owners, marks, bitmaps = sets.select("sid", "doc_id"), sets.select("sid", "n", "low"), found.where("sid is not null").select("sid", "bits")
    lists = meeting_lists(docs, n_docs).join(sets.select("sid", F.col("sid").bitwiseAND(F.lit(KEY)).alias("key")), "key").select("list", "sid")
    lists = materialise(lists, "lists")
    found_pairs = materialise(proposals(in_blocks(lists, marks.withColumn("grp", F.col("sid")), bitmaps), True), "pairs")
    pairs = found_pairs.where("more is null").select("a", "b")
    links = materialise(verify(pairs, docs, owners), "links")
    groups = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = marks.join(groups.withColumnRenamed("id", "sid"), "sid", "left").withColumn("grp", F.coalesce("component", "sid")).drop("component")
    left_over = materialise(lists.join(small_or_plain(found_pairs.where("more is not null").select(F.col("more").alias("list")).distinct()), "list", "left_semi"), "lists")
    open_lists = left_over.join(named.select("sid", "grp"), "sid").groupBy("list").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("list")
    second = in_blocks(left_over.join(open_lists, "list", "left_semi"), named, bitmaps)
    more = proposals(second, False).where("more is null").select("a", "b").join(pairs, ["a", "b"], "left_anti")
    more = materialise(more, "pairs")
    if more.limit(1).count():
        links = links.unionByName(verify(more, docs, owners))
        groups = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    member = found.select("doc_id", "n", "sid").join(groups.withColumnRenamed("id", "sid"), "sid", "left")
    member = member.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "sid").alias("cls"))
    lowest = member.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"))
    member = member.join(lowest, "cls", "left").select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))
    return member


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every document's set size and component."""
    return components(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Best-fit packing of documents into sequences of at most LENGTH tokens, by hierarchical residual packing.

Tokens: the byte-level BPE file by the tokenizers library, then the end id. The tokenizer never joins characters
across a space that stands before a non-space, so texts are cut there and the ids of each such chunk are kept in
a bounded memory: the same ids as for the whole text (tested), several times faster.

Packing: pieces are dealt to partitions of bounded size; each packs its pieces best-fit, largest first, sends out the
nearly full bins, and the underfull bins become items of the next round, in which FAN_IN partitions meet in
one, until one partition is left. Best fit leaves at most one bin that is half empty or emptier in a partition (two would have been
one), so a merge of FAN_IN partitions can place at most FAN_IN items in bins of any one fill. A partition hands on no more than
that for each level to come, of each fill: a merge is bounded however many bins stay underfull, and nothing is lost by it.

Defined cases: null text is empty and gives one piece that holds the end id only; repeated rows are packed one by one;
a special-token string inside a text gets its own id, as the tokenizer gives it; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrylens.llm.common import arrow_rows, chunks, kept, materialise, sliced, table

LENGTH = 1024
END_ID = 2
CACHE_CHUNKS = 700_000
#: New chunks that go to the tokenizer as one text.
JOINED = 256
#: Pieces packed in one task of the first round, partitions that meet in one later, and tokens a bin may lack to go out early.
PIECES, FAN_IN, SLACK = 40_000, 8, 4

CUT = re.compile(r" (?=\S)")
LOOSE = re.compile(r" (?:\s|\Z)")
#: White space for Python that is none for the tokenizer; such texts, and those with special tokens, are encoded whole.
ODD = re.compile("[\x1c-\x1f]")


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes. Chunks are remembered in two generations: the older goes when the younger is full, but for what is met again."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        self.cache_chunks = cache_chunks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        # A chunk's first token, and no other of its tokens, begins with the sign that stands for a space.
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[k for t, k in vocabulary.items() if t.startswith("\u0120")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in got)]

    def encode_chunks(self, new: list[str]) -> list[bytes]:
        """Tokens of chunks, each with its space in front: many as one text, cut again where a token begins with a space."""
        groups = [new[k : k + JOINED] for k in range(0, len(new), JOINED)]
        out: list[bytes] = []
        for group, raw in zip(groups, self.encode([" " + " ".join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.begins[np.frombuffer(raw, "<u4")]) * 4
            if len(cuts) != len(group):
                out += self.encode([" " + c for c in group])
                continue
            edges = [*cuts.tolist(), len(raw)]
            out += [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        return out

    def learn(self, chunks: set[str]) -> None:
        """See to it that all chunks are known."""
        if len(self.known) > self.cache_chunks:
            self.known, self.older = {}, self.known
        new = chunks.difference(self.known)
        again = [c for c in new if c in self.older]
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        fresh = new.difference(again)
        loose = [c for c in fresh if " " in c]  # more than one token may begin with a space
        self.known.update(zip(loose, self.encode([" " + c for c in loose]), strict=True))
        fresh = list(fresh.difference(loose))
        self.known.update(zip(fresh, self.encode_chunks(fresh), strict=True))

    def ids(self, text: str) -> bytes:
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """What is new in all the texts goes to the tokenizer in one batch; hand over texts of bounded length together."""
        whole = [bool(ODD.search(t) or self.special.search(t)) for t in texts]
        parts = [[t] if w else CUT.split(t) if LOOSE.search(t) else t.split(" ") for t, w in zip(texts, whole, strict=True)]
        heads = self.encode([p.pop(0) for p in parts])
        self.learn(set().union(*parts))
        return [h + b"".join(map(self.known.__getitem__, p)) for h, p in zip(heads, parts, strict=True)]


def cut(ids: bytes) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces: the first takes what full pieces leave over."""
    n = len(ids) // 4
    first = n % LENGTH or LENGTH
    edges = [0, *range(first, n + 1, LENGTH)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(edges, edges[1:], strict=False)]


def pieces_of(docs: DataFrame, tokenizer_path: str | None = None, cache_chunks: int = CACHE_CHUNKS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), the rows of documents cut into pieces."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        if tokenizer_path is None:
            import public_tokenizers

        path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
        own = kept(("tokens", path, cache_chunks), lambda: Encoder(path, cache_chunks))  # a worker runs many tasks
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in sliced(batches):
            docs, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            rows = [(d, k, *p) for i, j in chunks(texts) for d, ids in zip(docs[i:j], own.all_ids(texts[i:j]), strict=True) for k, p in enumerate(cut(ids + end))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items in order of falling size: bin, offset in it, and the bins' fill."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    rooms: list[int] = []  # distinct residuals that open bins have
    at: dict[int, list[int]] = {}
    for i in order:
        s = int(sizes[i])
        k = bisect_left(rooms, s)
        if k < len(rooms):
            room = rooms[k]
            b = at[room].pop()
            if not at[room]:
                rooms.pop(k)
        else:
            b, room = len(fill), LENGTH
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        left = room - s
        if left:
            if not at.setdefault(left, []):
                insort(rooms, left)
            at[left].append(b)
    return bins, offsets, np.array(fill, np.int64)


def handed_on(fill: np.ndarray, most: int) -> np.ndarray:
    """Whether each bin goes to the next round: underfull, and among the first bins of its fill."""
    order = np.argsort(fill, kind="stable")
    of = fill[order]
    rank = np.empty(len(fill), np.int64)
    rank[order] = np.arange(len(fill)) - np.searchsorted(of, of)
    return (fill < LENGTH - SLACK) & (rank < most)


def pack(pieces: DataFrame, n_rows: int | None = None) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32), materialised -> the same with sequence_id and offset.

    sequence_id: 64-bit, made of the round, the group and the bin in it.
    """
    spark = pieces.sparkSession
    n = pieces.count() if n_rows is None else n_rows
    groups = max(1, -(-n // PIECES))
    salted = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(groups))
    levels = next(k for k in range(64) if FAN_IN**k >= groups)
    most, level = FAN_IN * (levels + 1), 0
    full = pieces.where(F.col("length") == LENGTH).withColumns({"sequence_id": F.monotonically_increasing_id() + (F.lit(1).cast("long") * (1 << 62)), "offset": F.lit(0).cast("long")})
    items = pieces.where(F.col("length") < LENGTH).withColumns({"grp": salted, "size": F.col("length")})
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, grp long, bin long, at long, fill long, more boolean"

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece", "start"], kind="stable", ascending=[False, True, True, True]).reset_index(drop=True)
        bins, offsets, fill = best_fit(pdf["size"].to_numpy())
        out = pdf[["doc_id", "piece", "start", "length", "ids_crc32", "grp"]].copy()
        out["bin"], out["at"], out["fill"], out["more"] = bins, offsets, fill[bins], handed_on(fill, most)[bins]
        return out

    placed = materialise(items.groupBy("grp").applyInPandas(local, schema), "packed")
    placed = placed.withColumns({"sequence_id": F.col("grp") * (1 << 24) + F.col("bin"), "offset": F.col("at")}).drop("bin", "at", "grp")
    # Later rounds move whole bins: (sequence_id, fill) of the underfull ones, a few per group.
    bins = placed.where("more").select("sequence_id", F.col("fill").alias("size")).distinct()
    bins = bins.withColumn("grp", F.expr(f"sequence_id div {1 << 24}"))
    moves = None

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "root"], kind="stable", ascending=[False, True]).reset_index(drop=True)
        b, offsets, fill = best_fit(pdf["size"].to_numpy())
        heads = pdf["root"].to_numpy()[np.unique(b, return_index=True)[1]]
        return pd.DataFrame({"root": pdf["root"], "to": heads[b], "by": offsets, "fill": fill[b], "grp": pdf["grp"], "more": handed_on(fill, most)[b]})

    bins = materialise(bins.select(F.col("sequence_id").alias("root"), "size", "grp"), "bins")
    while groups > 1:
        groups, level = -(-groups // FAN_IN), level + 1
        step = bins.withColumn("grp", F.expr(f"grp div {FAN_IN}")).groupBy("grp").applyInPandas(merge, "root long, to long, by long, fill long, grp long, more boolean")
        step = materialise(step, "merge")
        moves = step.select(F.col("root").alias("own"), "to", "by") if moves is None else (
            moves.join(step.select(F.col("root").alias("to"), F.col("to").alias("next"), F.col("by").alias("more")), "to", "left")
            .select("own", F.coalesce("next", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by")))
        moves = materialise(moves, "moves")
        bins = step.where((F.col("root") == F.col("to")) & F.col("more")).select("root", F.col("fill").alias("size"), "grp")
    if moves is not None:
        placed = placed.join(moves, placed["sequence_id"] == moves["own"], "left")
        placed = placed.withColumns({"sequence_id": F.coalesce("to", "sequence_id"), "offset": F.col("offset") + F.coalesce("by", F.lit(0))})
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(names).unionByName(full.select(names))


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, cache_chunks: int = CACHE_CHUNKS) -> DataFrame:
    """docs packed into sequences. A worker remembers up to twice cache_chunks chunks at about 150 bytes; fewer cost time alone."""
    with arrow_rows(docs.sparkSession):
        pieces = materialise(pieces_of(docs, tokenizer_path, cache_chunks), "pieces")
    return pack(pieces)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))

"""Dataflow over control-flow graphs: many small graphs side by side.

Edges and facts of a method are dealt to one partition and sorted by method; a task reads them as a stream and holds one
Arrow batch and one method at a time. A method's blocks and edges are bounded by the 64 KiB code limit. Facts come back as rows.
Rows with a null method are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def _per_method(edges: DataFrame, facts: DataFrame | None, run, schema: str) -> DataFrame:
    """run(pairs, facts) for each method: pairs (src, dst), facts (block, slot, kind); its rows come back after the method."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    rows = edges.select("method", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("edge").alias("kind"))
    if facts is not None:
        rows = rows.unionByName(facts.select("method", F.col("block").alias("a"), F.col("slot").alias("b"), "kind"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        method, kind = pdf["method"].to_numpy(), pdf["kind"].to_numpy()
        triples = list(zip(pdf["a"].tolist(), pdf["b"].tolist(), kind, strict=True))
        cuts = np.flatnonzero(np.concatenate(([True], method[1:] != method[:-1])))
        out = []
        for i, j in zip(cuts, [*cuts[1:], len(method)], strict=True):
            own = triples[i:j]
            out += [(int(method[i]), *r) for r in run([(a, b) for a, b, k in own if k == "edge"], [x for x in own if x[2] != "edge"])]
        return pd.DataFrame(out, columns=names, dtype=object)

    def stream(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf])
            if len(pdf):
                last = int(np.searchsorted(pdf["method"].to_numpy(), pdf["method"].iloc[-1]))
                held = pdf.iloc[last:]
                if last:
                    yield solve(pdf.iloc[:last])
        if held is not None:
            yield solve(held)

    return rows.where("method is not null").repartition("method").sortWithinPartitions("method").mapInPandas(stream, schema)


def blocks_of(leaders: DataFrame) -> DataFrame:
    """(method, block, start, end) from instructions (method, pc, is_leader, ends_block): blocks start at leaders and after block ends."""
    from pyspark.sql import Window

    w = Window.partitionBy("method").orderBy("pc")
    starts = F.coalesce(F.lag("ends_block").over(w), F.lit(True)) | F.col("is_leader")
    rows = leaders.withColumn("block", (F.sum(starts.cast("int")).over(w) - 1).cast("long"))
    return rows.groupBy("method", "block").agg(F.min("pc").alias("start"), F.max("pc").alias("end"))


def _walk(pairs: list[tuple[int, int]]) -> tuple[dict, dict, list]:
    """Successors, predecessors and reverse postorder from the entry (the smallest block)."""
    succ: dict[int, list[int]] = {}
    for a, b in pairs:
        succ.setdefault(a, []).append(b)
        succ.setdefault(b, [])
    for v in succ.values():
        v.sort()
    pred: dict[int, list[int]] = {k: [] for k in succ}
    for a, v in succ.items():
        for b in v:
            pred[b].append(a)
    entry, order, seen = min(succ), [], set()
    stack = [(entry, 0)]
    seen.add(entry)
    while stack:
        node, k = stack.pop()
        if k < len(succ[node]):
            stack.append((node, k + 1))
            nxt = succ[node][k]
            if nxt not in seen:
                seen.add(nxt)
                stack.append((nxt, 0))
        else:
            order.append(node)
    return succ, pred, order[::-1]


def _idoms(pairs: list[tuple[int, int]]) -> tuple[dict, dict, dict]:
    succ, pred, order = _walk(pairs)
    rank = {n: k for k, n in enumerate(order)}
    idom = {order[0]: order[0]}
    changed = True
    while changed:
        changed = False
        for n in order[1:]:
            new = None
            for p in pred[n]:
                if p in idom:
                    a, b = p, p if new is None else new
                    while a != b:
                        if rank[a] > rank[b]:
                            a = idom[a]
                        else:
                            b = idom[b]
                    new = a
            if idom.get(n) != new:
                idom[n], changed = new, True
    return succ, pred, idom


def dominators(edges: DataFrame) -> DataFrame:
    """(method, block, idom) for blocks reachable from the entry; the entry has none."""

    def run(pairs, _):
        return [(n, None if n == d else d) for n, d in _idoms(pairs)[2].items()]

    return _per_method(edges, None, run, "method long, block long, idom long")


def frontiers(edges: DataFrame) -> DataFrame:
    """(method, block, frontier): dominance frontier, one row for each member."""

    def run(pairs, _):
        _, pred, idom = _idoms(pairs)
        rows = set()
        for n in idom:
            ps = [p for p in pred[n] if p in idom]
            if len(ps) > 1 or (ps and idom[n] == n):
                for p in ps:
                    while p != idom[n] or (p == n and idom[n] == n):
                        rows.add((p, n))
                        if idom[p] == p:
                            break
                        p = idom[p]
        return sorted(rows)

    return _per_method(edges, None, run, "method long, block long, frontier long")


def dominated(idoms: DataFrame, rounds: int = 64) -> DataFrame:
    """(method, block, below): every block that a block dominates, itself left out; closure by doubling."""
    from quarrylens.storage import materialise

    out = materialise(idoms.where("idom is not null").select("method", F.col("idom").alias("block"), F.col("block").alias("below")), "dominated")
    n = out.count()
    for _ in range(rounds):
        more = out.alias("a").join(out.alias("b"), (F.col("a.method") == F.col("b.method")) & (F.col("a.below") == F.col("b.block"))).select("a.method", "a.block", "b.below")
        out = materialise(out.unionByName(more).distinct(), "dominated")
        m = out.count()
        if m == n:
            break
        n = m
    return out


def loops(edges: DataFrame) -> DataFrame:
    """(method, head, tail, block): natural loops of back edges tail -> head, a row for each block in them."""

    def run(pairs, _):
        succ, pred, idom = _idoms(pairs)

        def dominates(a: int, b: int) -> bool:
            while b != a and idom[b] != b:
                b = idom[b]
            return a == b

        rows = []
        for a in idom:
            for h in succ[a]:
                if h in idom and dominates(h, a):
                    body, stack = {h}, [a]
                    while stack:
                        n = stack.pop()
                        if n not in body:
                            body.add(n)
                            stack += [p for p in pred[n] if p in idom]
                    rows += [(h, a, n) for n in sorted(body)]
        return rows

    return _per_method(edges, None, run, "method long, head long, tail long, block long")


def _graph(pairs: list, facts: list) -> tuple[dict, dict, dict]:
    """Successors, used slots and defined slots of each block."""
    succ: dict[int, set[int]] = {}
    for a, b in pairs:
        succ.setdefault(a, set()).add(b)
        succ.setdefault(b, set())
    sets: dict[str, dict[int, set[int]]] = {"use": {}, "def": {}}
    for b, s, k in facts:
        succ.setdefault(b, set())
        sets[k].setdefault(b, set()).add(s)
    return succ, sets["use"], sets["def"]


def liveness(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """(method, block, slot, live_in, live_out): backward fixpoint; a use counts before the block's own definition."""

    def run(pairs, own):
        succ, use, define = _graph(pairs, own)
        ins, outs = {n: set(use.get(n, ())) for n in succ}, {n: set() for n in succ}
        todo = True
        while todo:
            todo = False
            for n in sorted(succ, reverse=True):
                outs[n] = set().union(*[ins[s] for s in succ[n]]) if succ[n] else set()
                new = use.get(n, set()) | (outs[n] - define.get(n, set()))
                if new != ins[n]:
                    ins[n], todo = new, True
        return [(n, s, s in ins[n], s in outs[n]) for n in succ for s in sorted(ins[n] | outs[n])]

    return _per_method(edges, facts, run, "method long, block long, slot long, live_in boolean, live_out boolean")


def reaching(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """(method, block, slot, def_block): definitions that reach a block's start, by slot."""

    def run(pairs, own):
        succ, _, define = _graph(pairs, own)
        pred = {n: [] for n in succ}
        for a, v in succ.items():
            for b in v:
                pred[b].append(a)
        ins = {n: set() for n in succ}
        todo = True
        while todo:
            todo = False
            for n in sorted(succ):
                new = {(s, d) for p in pred[n] for s, d in ins[p] if s not in define.get(p, ())} | {(s, p) for p in pred[n] for s in define.get(p, ())}
                if new != ins[n]:
                    ins[n], todo = new, True
        return [(n, s, d) for n in succ for s, d in sorted(ins[n])]

    return _per_method(edges, facts, run, "method long, block long, slot long, def_block long")


def intervals(live: DataFrame, spans: DataFrame) -> DataFrame:
    """(method, slot, start, end): from the first to the last instruction of the blocks in which a slot is live."""
    rows = live.join(spans, ["method", "block"])
    return rows.groupBy("method", "slot").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def phis(front: DataFrame, live: DataFrame, facts: DataFrame) -> DataFrame:
    """(method, block, slot): pruned phi places, the iterated frontier of each slot's definitions where it is live in.

    Each slot is worked out by itself, so that one slot's visit does not stop another's.
    """
    from quarrylens.storage import materialise

    # Written before the rounds, so that none goes through the methods again.
    live = materialise(live.select("method", "block", "slot", "live_in", "live_out"), "live")
    front = materialise(front.select("method", "block", "frontier"), "frontiers")
    use = live.where("live_in").select("method", F.col("block").alias("frontier"), "slot")
    out = live.where("live_out").select("method", "block", "slot")
    work = facts.where("kind = 'def'").select("method", "block", "slot").distinct()
    # A place follows from a definition or a place before it, wherever both are live; the rounds only look at these pairs.
    ways = materialise(out.join(front, ["method", "block"]).join(use, ["method", "frontier", "slot"], "left_semi").select("method", "block", "slot", "frontier").distinct(), "ways")
    found = None
    while True:
        step = work.join(ways, ["method", "block", "slot"]).select("method", F.col("frontier").alias("block"), "slot").distinct()
        step = materialise(step if found is None else step.join(found, ["method", "block", "slot"], "left_anti"), "phis")
        if not step.limit(1).count():
            return step if found is None else found
        found = step if found is None else materialise(found.unionByName(step), "phis")
        work = step

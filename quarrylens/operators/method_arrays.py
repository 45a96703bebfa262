"""Unflattening of many small methods at once as arrays, the inside of a task of `unflatten.unflattened_methods`.

Rows (method, part, a, b, slot, rank, op, value) come in order of method; part tells the table: an edge (a, b), an effect (a, slot, value), an arm (a, slot, rank, op, value
and its target b) or an entry (a). A task holds the methods of about CHUNK rows and five bytes for each of their possible states (slot, block, value).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

EDGE, EFFECT, ARM, ENTRY = range(4)
#: Ops and kinds come and go as their places here; ops in the order in which arms of one rank stand.
OPS, KINDS = ["eq", "else", "ge", "gt", "le", "lt", "ne"], ["jump", "redirected", "arm"]
TESTS = {"eq": np.equal, "ge": np.greater_equal, "gt": np.greater, "le": np.less_equal, "lt": np.less, "ne": np.not_equal}
#: Rows that are gone through at once; a method's rows stay together.
CHUNK = 200_000


def stream(batches: Iterator[pa.RecordBatch], states: int, passes: int) -> Iterator[pa.RecordBatch]:
    """(method, src, dst, kind) of rows in order of method."""
    held, n, enough = [], 0, CHUNK
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= enough:
            rows = pa.Table.from_batches(held).combine_chunks()
            last = int(pc.index(rows["method"], rows["method"][n - 1]).as_py())
            if last:
                yield from solved(rows.slice(0, last), states, passes)
            held, n = rows.slice(last).to_batches(), n - last
            enough = max(CHUNK, 2 * n)
    if n:
        yield from solved(pa.Table.from_batches(held), states, passes)


def solved(rows: pa.Table, states: int, passes: int) -> Iterator[pa.RecordBatch]:
    """Whole methods, halved as long as several together have more than so many possible states."""
    method, methods = codes(rows["method"])
    slot, part, n = codes(rows["slot"])[0], rows["part"].to_numpy(), len(methods)
    count = lambda at: np.bincount(at, minlength=n).astype(float)
    arm = (part == ARM) & (slot >= 0)
    wide = slot.max(initial=0) + 1
    slots = count(distinct(method[arm] * wide + slot[arm]) // wide)
    bound = (count(method) + count(method[rows["b"].is_valid().to_numpy()])) * (count(method[rows["value"].is_valid().to_numpy()]) + 1) * slots
    if n > 1 and bound.sum() > states:
        half = int(np.clip(np.searchsorted(np.cumsum(bound), bound.sum() / 2), 1, n - 1))
        cut = int(np.searchsorted(method, half))
        yield from solved(rows.slice(0, cut), states, passes)
        yield from solved(rows.slice(cut), states, passes)
    else:
        yield from solve(rows, method, methods, slot, passes).to_batches()


def distinct(x: np.ndarray) -> np.ndarray:
    """In order, each once."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def codes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(numbers in order of first appearance, -1 for null; the values that they stand for)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = column.dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def spans(counts: np.ndarray) -> np.ndarray:
    """Numbers from 0 within each of the spans of these lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Lists:
    """The values of each key below n."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, n: int):
        order = np.argsort(keys, kind="stable")
        self.values, self.counts = values[order], np.bincount(keys, minlength=n)
        self.starts = np.cumsum(self.counts) - self.counts

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in keys, value) for all values of these keys, in order of keys."""
        counts = self.counts[keys]
        at = np.repeat(np.arange(len(keys)), counts)
        return at, self.values[np.repeat(self.starts[keys], counts) + spans(counts)]


def only_target(group: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    """For each group below n the one target of its rows; -1 if they have several, none or an unknown one (-1)."""
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(least, group, target)
    np.maximum.at(most, group, target)
    return np.where(least == most, most, -1)


def first_arms(cell_of: np.ndarray, width: np.ndarray, hub: np.ndarray, rank: np.ndarray, op: np.ndarray, operand: np.ndarray, known: np.ndarray, target: np.ndarray, numbers: np.ndarray, number_of: np.ndarray, cells: int) -> np.ndarray:
    """The target of each cell (hub, value): that of the first arm that holds, -1 where none does and for the unknown value 0.

    A hub's arms go by rank, op, operand (known or none) and target. Its cells start at cell_of and are width many, the numbers of its values start at number_of.
    """
    order = np.lexsort((rank, hub))
    if ((np.diff(hub[order]) == 0) & (np.diff(rank[order]) == 0)).any():
        order = np.lexsort((target, np.where(known, operand, 0), known, op, rank))
    hub, op, operand, known, target = (x[order] for x in (hub, op, operand, known, target))
    best = np.full(cells, len(hub))
    for place, name in enumerate(OPS):
        at = np.flatnonzero((op == place) & (known | (name == "else")))
        # Each arm meets all values of its method.
        many = width[hub[at]] - 1
        arm, k = np.repeat(at, many), spans(many)
        if name != "else":
            holds = TESTS[name](numbers[number_of[hub[arm]] + k], operand[arm])
            arm, k = arm[holds], k[holds]
        np.minimum.at(best, cell_of[hub[arm]] + k + 1, arm)
    return np.append(target, -1)[best]


def solve(rows: pa.Table, method: np.ndarray, methods: pa.Array, slot: np.ndarray, passes: int) -> pa.Table:
    """(method, src, dst, kind) of whole methods, all of them a step at a time; method and slot as codes."""
    part = rows["part"].to_numpy()
    ends, blocks = codes(pa.concat_arrays([rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c] for c in ("a", "b")]))
    # Nodes (method, block) are numbered in their order, on which arms of one rank depend; an end without a block (-1) is a node of its own that leads nowhere.
    wide = len(blocks) + 1
    by_value = pc.array_sort_indices(blocks).to_numpy()
    place = np.full(wide, -1)
    place[by_value] = np.arange(len(blocks))
    ends, blocks = place[ends], blocks.take(pa.array(by_value))
    found = pd.factorize(np.concatenate([method, method]) * wide + ends + 1)
    order = np.argsort(found[1])
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    nodes, a, b = found[1][order], *np.split(rank[found[0]], 2)
    node_method, node_block = nodes // wide, nodes % wide - 1
    n, m = len(nodes), len(methods)

    edge, effect, arm, entry = (np.flatnonzero(part == k) for k in (EDGE, EFFECT, ARM, ENTRY))
    value, known = rows["value"].fill_null(0).to_numpy(), rows["value"].is_valid().to_numpy()
    # Slots that a method's arms compare and its constants are numbered within it; value 0 is the unknown one.
    slotted, own_slots, first_slot = within(method[arm], slot[arm], m)
    constant, constants = pd.factorize(value[known])
    valued, own_values, first_value = within(method[known], constant, m)
    constants = constants[own_values[1]]
    slot_count, width = np.diff(first_slot), np.diff(first_value) + 1
    number = np.zeros(len(value), np.int64)
    number[known] = valued + 1

    # A key is a (node, slot), a state a (key, value); both lie dense.
    keys_of = slot_count[node_method]
    key_at = np.concatenate(([0], np.cumsum(keys_of)))
    key_node = np.repeat(np.arange(n), keys_of)
    key_slot = spans(keys_of)
    state_of = width[node_method[key_node]]
    state_at = np.concatenate(([0], np.cumsum(state_of)))

    stored = np.full(len(key_node), -1)
    tracked = find(own_slots, method[effect], slot[effect])
    effect, tracked = effect[tracked >= 0], tracked[tracked >= 0]
    stored[key_at[a[effect]] + tracked - first_slot[method[effect]]] = number[effect]

    hub_key, arm_hub = np.unique(key_at[a[arm]] + slotted, return_inverse=True)
    hub_node, hub_slot = key_node[hub_key], key_slot[hub_key]
    hub_width = width[node_method[hub_node]]
    cell_at = np.cumsum(hub_width) - hub_width
    target = np.where(node_block[b[arm]] >= 0, b[arm], -1)
    ops, ranks = (rows[c].fill_null(-1).to_numpy()[arm] for c in ("op", "rank"))
    cell = first_arms(cell_at, hub_width, arm_hub, ranks, ops, value[arm], known[arm], target, constants, first_value[node_method[hub_node]], int(hub_width.sum()))
    key_hub = np.full(len(key_node), -1)
    key_hub[hub_key] = np.arange(len(hub_key))
    hubs_at = Lists(hub_node, np.arange(len(hub_key)), n)

    pair = distinct(a[edge] * n + b[edge])
    arm_pair = distinct(a[arm] * n + b[arm])
    moved, closed = [], []
    active = np.ones(m, bool)
    for _ in range(passes):
        src, dst = pair // n, pair % n
        ways = Lists(np.concatenate([src, arm_pair // n]), np.concatenate([dst, arm_pair % n]), n)
        begin = a[entry[active[method[entry]]]]
        at = np.repeat(begin, keys_of[begin])
        key, val = states(key_at[at] + spans(keys_of[begin]), key_at, key_node, key_slot, stored, key_hub, cell_at, cell, ways, state_at)
        by_key = Lists(key, val, len(key_node))

        # Edges into hubs: where every value at the start's end leads to one and the same arm.
        e, hub = hubs_at.of(dst)
        e, hub = (x[key_hub[hub_key[hub]] >= 0] for x in (e, hub))
        from_key = key_at[src[e]] + hub_slot[hub]
        k, v = by_key.of(from_key)
        v = np.where(stored[from_key[k]] >= 0, stored[from_key[k]], v)
        to = only_target(e[k], cell[cell_at[hub[k]] + v], len(pair))
        to = np.where(to == dst, -1, to)
        fresh = np.flatnonzero(to >= 0)
        moved.append(src[fresh] * n + to[fresh])
        pair = np.where(to >= 0, src * n + to, pair)

        # Hubs of which that holds themselves become plain blocks.
        hub = np.flatnonzero(key_hub[hub_key] >= 0)
        k, v = by_key.of(hub_key[hub])
        to = only_target(k, cell[cell_at[hub[k]] + v], len(hub))
        plain = hub_node[hub[to >= 0]]
        pair = distinct(np.concatenate([pair, plain * n + to[to >= 0]]))
        gone = np.zeros(n, bool)
        gone[plain] = True
        key_hub[hub_key[gone[hub_node]]] = -1
        arm_pair = arm_pair[~gone[arm_pair // n]]

        # Only methods in which something has changed and an edge still leads into a hub are gone through again.
        left = np.zeros(n, bool)
        left[hub_node[key_hub[hub_key] >= 0]] = True
        changed, into = np.zeros(m, bool), np.zeros(m, bool)
        changed[node_method[src[fresh]]] = True
        into[node_method[(pair // n)[left[pair % n]]]] = True
        active = changed & into
        again = active[node_method[pair // n]]
        closed.append((pair[~again], arm_pair[~active[node_method[arm_pair // n]]]))
        pair, arm_pair = pair[again], arm_pair[active[node_method[arm_pair // n]]]
        key_hub[hub_key[~active[node_method[hub_node]]]] = -1
        if not active.any():
            break
    else:
        raise RuntimeError("unflattening did not settle")

    jumps, arms = (np.concatenate(x) for x in zip(*closed, strict=True))
    kind = np.concatenate([np.isin(jumps, np.concatenate(moved)).astype(np.int8), np.full(len(arms), 2, np.int8)])
    left = np.concatenate([jumps, arms])
    live = reached(a[entry], Lists(left // n, left % n, n), n)
    kept = live[left // n]
    left, kind = left[kept], kind[kept]
    name = lambda at: blocks.take(pa.array(node_block[at], mask=node_block[at] < 0))
    return pa.table({"method": methods.take(pa.array(node_method[left // n])), "src": name(left // n), "dst": name(left % n), "kind": pa.array(kind)})


def within(method: np.ndarray, item: np.ndarray, m: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(each row's item, a small number, as one within its method; the distinct (methods, items) in order; where each method's start)."""
    pair = method * (item.max(initial=0) + 2) + item
    order = np.argsort(pair, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.diff(pair[order]) != 0
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    pairs = method[order[new]], item[order[new]]
    first = np.searchsorted(pairs[0], np.arange(m + 1))
    return at - first[method], pairs, first


def find(pairs: tuple[np.ndarray, np.ndarray], method: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Where (method, item) stands among distinct pairs of small numbers in order; -1 if it doesn't."""
    wide = max(pairs[1].max(initial=0), item.max(initial=0)) + 2
    known, asked = pairs[0] * wide + pairs[1], method * wide + item
    at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
    return np.where(known[at] == asked, at, -1) if len(known) else np.full(len(asked), -1)


def states(start, key_at, key_node, key_slot, stored, key_hub, cell_at, cell, ways: Lists, state_at) -> tuple[np.ndarray, np.ndarray]:
    """(key, value) of all states that the unknown value at the start keys leads to."""
    seen, place = np.zeros(state_at[-1], bool), np.empty(state_at[-1], np.int32)
    key = distinct(start)
    val = np.zeros(len(key), np.int64)
    seen[state_at[key]] = True
    keys, vals = [key], [val]
    while len(key):
        end = np.where(stored[key] >= 0, stored[key], val)
        hub = key_hub[key]
        told = (hub >= 0) & (end > 0)
        to = cell[cell_at[hub[told]] + end[told]]
        at, all_to = ways.of(key_node[key[~told]])
        to = np.concatenate([to, all_to])
        slot = np.concatenate([key_slot[key[told]], key_slot[key[~told]][at]])
        end = np.concatenate([end[told], end[~told][at]])
        slot, end, to = slot[to >= 0], end[to >= 0], to[to >= 0]
        key = key_at[to] + slot
        state = state_at[key] + end
        new = np.flatnonzero(~seen[state])
        state = state[new]
        # Of equal states the one whose place was written last stays.
        seen[state] = True
        place[state] = new
        new = new[place[state] == new]
        key, val = key[new], end[new]
        keys.append(key)
        vals.append(val)
    return np.concatenate(keys), np.concatenate(vals)


def reached(start: np.ndarray, ways: Lists, n: int) -> np.ndarray:
    """Which of n nodes ways lead to from the start."""
    seen = np.zeros(n, bool)
    todo = distinct(start)
    while len(todo):
        seen[todo] = True
        todo = ways.of(todo)[1]
        todo = distinct(todo[~seen[todo]])
    return seen

"""N-gram Jaccard join by count vectors and an R-tree, exact.

1. Every text becomes a set of 64-bit shingle hashes. Equal sets are one node from here on, so copies are never expanded.
2. How many nodes have a shingle is counted for all shingles: tasks send sorted, delta-coded runs of hashes by ranges of the
   hash, and the ranges answer with the shingles that at least two nodes have.
3. With shingles ordered from rare to frequent, two linked nodes share one within the first n - ceil(0.8 n) + 1 of either (the prefix).
   A shingle's nodes are its posting list. A node whose own shingles fill its prefix has no partner.
4. A node's shared shingles are hashed into groups; the counts by group are its point. The sum of coordinate minima
   bounds the overlap of two points, and that of a point with the upper corner of a box bounds its overlap with all points in it.
5. Each list's first node, and then a few of its largest component, are bounded and verified against the others. Where a list
   still holds several components, the nodes outside its largest one search an R-tree over the list's points for
   partners in other components; pairs that survive the bound are verified on their shingles. Pairs inside a component need no look,
   and large lists are cut into cells.
6. Components of all verified links, by alternating stars.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import gather
from .common import Scratch, power_of_two, table

GROUPS = 256
_rng = np.random.default_rng(20240607)
_ODD = _rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[[0x20, *range(0x09, 0x0E)]] = 0
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        n = 1 << int(n).bit_length()
        _POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, 0x9E3779B97F4A7C15, np.uint64))), dtype=np.uint64)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; data: the texts' UTF-8 bytes, bounds: where each begins, and the end.

    Words are lower-cased in A-Z alone. With fewer words than width the whole sequence is one shingle; without words, none."""
    docs = len(bounds) - 1
    value = _BYTE[data]
    solid = value != 0
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inside = bounds[:-1][(bounds[:-1] < len(data))]
    first[inside] |= solid[inside]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * docs
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))), axis=0)[: len(data)] if starts[0] == 0 else None
    if place is None:
        place = np.zeros(len(data), np.int64)
        place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    word = mix(np.add.reduceat(value * _powers(int(place.max()) + 1)[place], starts))
    edge = np.searchsorted(starts, bounds)
    n = np.diff(edge)
    if len(word) >= width:
        whole = sum((word[k : len(word) - width + 1 + k] * _ODD[k] for k in range(1, width)), word[: len(word) - width + 1] * _ODD[0])
        whole = mix(whole)
    else:
        whole = np.zeros(0, np.uint64)
    out = []
    for a, size in zip(edge[:-1].tolist(), n.tolist(), strict=True):
        if size >= width:
            out.append(np.unique(whole[a : a + size - width + 1]))
        elif size:
            out.append(mix((word[a : a + size] * _ODD[:size]).sum(keepdims=True) + np.uint64(size) * _ODD[7]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def batch_sets(column, width: int, most: int = 4 << 20):
    """(row, shingle hashes) of an Arrow column of strings, from its buffers, some MB at a time."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        part = offsets[a : b + 1] - offsets[a]
        yield from enumerate(shingle_sets(data[offsets[a] : offsets[b]], part, width), a)
        a = b


def node_id(tokens: np.ndarray) -> int:
    """A set's 64-bit fingerprint: equal for equal sets."""
    return int(mix(tokens + _ODD[5]).sum(dtype=np.uint64).view(np.int64)) if len(tokens) else 0


def pack(tokens: np.ndarray) -> bytes:
    """Ascending hashes as differences in byte planes: the upper planes are zeros, which the shuffle's codec removes."""
    return np.diff(tokens, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


class RTree:
    """Points (set size, counts by group), packed: by size into slabs, within a slab by the coordinate that varies most. A box
    has the least size and the upper corner of what is below it."""

    def __init__(self, size: np.ndarray, points: np.ndarray, fan_out: int = 32):
        m = len(size)
        order = np.argsort(size, kind="stable")
        slab = max(fan_out, int(np.ceil(np.sqrt(m / fan_out))) * fan_out)
        parts = [o[np.argsort(points[o, int(points[o].var(0).argmax())], kind="stable")] for o in (order[i : i + slab] for i in range(0, m, slab))]
        self.order, self.fan_out = np.concatenate(parts) if parts else order, fan_out
        self.levels = [(size[self.order], size[self.order], points[self.order])]  # least size, greatest size, upper corner
        while len(self.levels[-1][0]) > fan_out:
            low, high, corner = self.levels[-1]
            at = np.arange(0, len(low), fan_out)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(corner, at, 0)))

    def search(self, size: np.ndarray, points: np.ndarray, percent: int, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) numbers of all pairs whose bound allows a similarity of percent."""
        top = len(self.levels[-1][0])
        found = []
        step = max(1, most // max(1, top))
        for a in range(0, len(size), step):
            q = np.repeat(np.arange(a, min(a + step, len(size))), top)
            box = np.tile(np.arange(top), len(q) // top)
            for level in range(len(self.levels) - 1, -1, -1):
                low, high, corner = self.levels[level]
                ok = (100 * high[box] >= percent * size[q]) & (100 * size[q] >= percent * low[box])
                q, box = q[ok], box[ok]
                keep = []
                for i in range(0, len(q), most):
                    x, y = q[i : i + most], box[i : i + most]
                    both = np.minimum(points[x], corner[y]).sum(1, dtype=np.int64)
                    keep.append((100 + percent) * both >= percent * (size[x] + low[y]))
                ok = np.concatenate(keep) if keep else np.zeros(0, bool)
                q, box = q[ok], box[ok]
                if level:
                    below = len(self.levels[level - 1][0])
                    q = np.repeat(q, self.fan_out)
                    box = (box[:, None] * self.fan_out + np.arange(self.fan_out)).ravel()
                    q, box = q[box < below], box[box < below]
            found.append((q, self.order[box]))
        return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n, node): the size of each row's set and its fingerprint."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [s for _, s in batch_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_id(s) for s in sets], pa.int64())], names=["doc_id", "n", "node"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, node long")


def shared_shingles(docs: DataFrame, text_col: str, width: int, ranges: int, blocks: int, hold: int = 1_500_000) -> DataFrame:
    """(block, nodes, sizes, at, tokens, counts), binary: for blocks of nodes, the shingles that at least two nodes have and
    how many have them."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def send(batches):
        import pyarrow as pa

        sets: dict[int, np.ndarray] = {}
        size = 0

        def sent():
            nodes, sizes = np.array(list(sets), np.int64), np.array([len(x) for x in sets.values()], np.int32)
            flat = np.concatenate(list(sets.values()))
            at = np.repeat(np.arange(len(nodes), dtype=np.int32), sizes)
            order = np.argsort(flat)
            flat, at = flat[order], at[order]
            part = (flat >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(flat), np.int64)
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=ranges))
            rows = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                used, own = np.unique(at[a:b], return_inverse=True)
                own = own.astype(np.uint16 if len(used) < 65536 else np.uint32)
                rows.append((int(part[a]), nodes[used].tobytes(), sizes[used].tobytes(), own.tobytes(), pack(flat[a:b])))
            sets.clear()
            kinds = (pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["range", "nodes", "sizes", "at", "tokens"])

        for batch in batches:
            for _, s in batch_sets(batch.column(0), width):
                if len(s) and (node := node_id(s)) not in sets:
                    sets[node] = s
                    size += len(s)
                    if size >= hold:
                        yield sent()
                        size = 0
        if sets:
            yield sent()

    def answer(key, pdf):
        import pandas as pd

        nodes, sizes, gid, flat = [], [], [], []
        for r in pdf.itertuples(index=False):
            own = np.frombuffer(r.nodes, np.int64)
            t = unpack(r.tokens)
            flat.append(t)
            gid.append(np.frombuffer(r.at, np.uint16 if len(r.at) == 2 * len(t) else np.uint32).astype(np.int64) + sum(map(len, nodes)))
            nodes.append(own)
            sizes.append(np.frombuffer(r.sizes, np.int32))
        nodes, back = np.unique(np.concatenate(nodes), return_inverse=True)
        size_of = np.zeros(len(nodes), np.int32)
        size_of[back] = np.concatenate(sizes)
        flat, gid = np.concatenate(flat), back[np.concatenate(gid)]
        order = np.argsort(flat, kind="stable")
        flat, gid = flat[order], gid[order]
        same = flat[1:] == flat[:-1]
        several = np.zeros(len(flat), bool)
        several[1:] |= same
        several[:-1] |= same
        flat, gid = flat[several], gid[several]
        order = np.lexsort((gid, flat))
        flat, gid = flat[order], gid[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (gid[1:] != gid[:-1])
        flat, gid = flat[new], gid[new]
        if not len(flat):
            return pd.DataFrame({"block": [], "nodes": [], "sizes": [], "at": [], "tokens": [], "counts": []}).astype({"block": "int32"})
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        count = np.diff(np.append(first, len(flat)))
        count = np.repeat(count, count)
        keep = count > 1
        flat, gid, count = flat[keep], gid[keep], count[keep]
        block = (mix(nodes[gid].view(np.uint64)) % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        flat, gid, count, block = flat[order], gid[order], count[order], block[order]
        edges = np.flatnonzero(np.diff(block, prepend=-1, append=blocks))
        rows = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            used, own = np.unique(gid[a:b], return_inverse=True)
            rows.append((block[a], nodes[used].tobytes(), size_of[used].tobytes(), own.astype(np.uint32).tobytes(), pack(flat[a:b]), count[a:b].astype(np.uint32).tobytes()))
        return pd.DataFrame(rows, columns=["block", "nodes", "sizes", "at", "tokens", "counts"])

    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(send, "range int, nodes binary, sizes binary, at binary, tokens binary")
    return sent.groupBy("range").applyInPandas(answer, "block int, nodes binary, sizes binary, at binary, tokens binary, counts binary")


def candidates(shared: DataFrame, percent: int, groups: int) -> DataFrame:
    """(node, n, tokens, point, prefix): the nodes that can have a partner, their shared shingles, counts by group and prefix."""

    def run(key, pdf):
        import pandas as pd

        nodes, sizes, at, flat, count, before = [], [], [], [], [], 0
        for r in pdf.itertuples(index=False):
            nodes.append(np.frombuffer(r.nodes, np.int64))
            sizes.append(np.frombuffer(r.sizes, np.int32))
            at.append(np.frombuffer(r.at, np.uint32).astype(np.int64) + before)
            before += len(nodes[-1])
            flat.append(unpack(r.tokens))
            count.append(np.frombuffer(r.counts, np.uint32))
        nodes, back = np.unique(np.concatenate(nodes), return_inverse=True)
        size_of = np.zeros(len(nodes), np.int64)
        size_of[back] = np.concatenate(sizes)
        at, flat, count = back[np.concatenate(at)], np.concatenate(flat), np.concatenate(count)
        order = np.lexsort((flat, count, at))
        at, flat = at[order], flat[order]
        edge = np.searchsorted(at, np.arange(len(nodes) + 1))
        rows = []
        for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            n = int(size_of[i])
            room = n - (percent * n + 99) // 100 + 1 - (n - (b - a))  # the shingles that nobody else has come first
            if room > 0:
                own = flat[a:b].view(np.int64)
                point = np.bincount((flat[a:b] % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.int32)
                rows.append((int(nodes[i]), n, np.sort(own), point, own[:room].copy()))
        return pd.DataFrame(rows, columns=["node", "n", "tokens", "point", "prefix"])

    return shared.groupBy("block").applyInPandas(run, "node long, n long, tokens array<long>, point array<int>, prefix array<long>")


def verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: first bounded by their points, then counted on their shingles."""
    point = found.select("node", "n", "point")
    x = pairs.join(point.withColumnsRenamed({"node": "a", "n": "na", "point": "pa"}), "a").join(point.withColumnsRenamed({"node": "b", "n": "nb", "point": "pb"}), "b")
    most = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, v: s + v)
    x = x.where((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")
    tokens = found.select("node", "tokens")
    x = x.join(tokens.withColumnsRenamed({"node": "a", "tokens": "ta"}), "a").join(tokens.withColumnsRenamed({"node": "b", "tokens": "tb"}), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    return x.where((100 + percent) * both >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for the nodes of links (a, b): the smallest node of each one's component, by alternating large and small stars."""

    def star(edges: DataFrame, step: str, large: bool) -> DataFrame:
        # edges go from v to u: both ways for the large star, from the greater to the smaller node for the small star
        least = scratch.write(edges.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m")), f"{step}-least")
        moved = edges.join(least, "v")
        moved = moved.where("u > v" if large else "u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        out = moved if large else moved.union(least.where("v <> m").select("v", F.col("m").alias("u")))
        return scratch.write(out.where("v <> u").distinct(), step)

    edges = scratch.write(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), f"{name}-0")
    i = 0
    while not are_stars(edges):
        i += 1
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        edges = star(star(both, f"{name}-{i}-large", True), f"{name}-{i}-small", False)
        scratch.drop(f"{name}-{i - 1}-small", f"{name}-{i}-large", f"{name}-{i}-large-least", f"{name}-{i}-small-least")
    labels = edges.select(F.col("v").alias("node"), F.col("u").alias("label"))
    return scratch.write(labels.union(edges.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()), name)


def are_stars(edges: DataFrame) -> bool:
    """Whether edges (v, u), all different, are stars already: each v has one u, and no u is a v. A look costs one shuffle, a round that changes nothing five."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("v"), F.lit(0).alias("u")).union(edges.select(F.col("u").alias("node"), F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("v").alias("v"), F.max("u").alias("u")).where("v > 1 or (v > 0 and u > 0)").count() == 0


def joined_components(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) as components gives them of the links that labels are of and these together: components of the links between labels, which are few."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"_{x}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = components(named.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")), scratch, f"{name}-between")
    moved = labels.join(between.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    return scratch.write(moved.union(between.join(labels.select("node"), "node", "left_anti").select("node", "label")), name)


def open_lists(postings: DataFrame, labels: DataFrame, scratch: Scratch, name: str = "open") -> DataFrame:
    """(token, nodes, top): the posting lists with several components, one of those that hold the same nodes, and their largest component."""
    named = postings.join(labels, "node", "left").select("token", "node", F.coalesce("label", "node").alias("label"))
    own = named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64(F.lit(7), "node").cast("decimal(38,0)")).alias("s2"))
    lists = own.groupBy("token").agg(F.sum("k").alias("nodes"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("k", "label")).alias("top"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    lists = lists.where("parts > 1").groupBy("nodes", "s1", "s2").agg(F.min("token").alias("token"), F.min("top").alias("top"))
    return scratch.write(lists.select("token", "nodes", F.col("top.label").alias("top"), (F.col("nodes") - F.col("top.k")).alias("probes")), name)


def hub_pairs(postings: DataFrame, lists: DataFrame, labels: DataFrame, hubs: int) -> DataFrame:
    """(a, b): each node outside a list's largest component with a few nodes of that component, by seeded hashes."""
    named = postings.join(lists.select("token", "top"), "token").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    inside = named.where("label = top").groupBy("token").agg(F.array(*[F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), F.col("node").alias("x"))) for i in range(hubs)]).alias("hubs"))
    inside = inside.select("token", F.col("hubs.x").alias("hubs"))
    out = named.where("label <> top").select("token", "node").join(inside, "token").select("node", F.explode("hubs").alias("hub"))
    return out.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def cell_links(key, probe, node, n, label, point, bounds, tokens, percent):
    """(a, b): links that join components inside one cell. Each query's partners in other components come out of the tree;
    the best bounds are verified first, and what has become one component needs no further look."""
    at, ask = np.flatnonzero(~probe), np.flatnonzero(probe)
    tree = RTree(n[at], point[at])
    names, comp = np.unique(label, return_inverse=True)
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, b = [], []
    for start in range(0, len(ask), 64):
        part = ask[start : start + 64]
        q, x = tree.search(n[part], point[part], percent)
        order = np.argsort(q, kind="stable")
        q, x = q[order], at[x[order]]
        edges = np.searchsorted(q, np.arange(len(part) + 1))
        for i, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            me, rest, step = part[i], x[lo:hi], 4
            own = find(comp[me])
            rest = rest[[find(c) != own for c in comp[rest].tolist()]]
            if not len(rest):
                continue
            most = np.minimum(point[rest], point[me]).sum(1)
            rest = rest[np.argsort(-most / (n[rest] + n[me]), kind="stable")]
            mine = tokens[bounds[me] : bounds[me + 1]]
            while len(rest):
                now, rest, step = rest[:step], rest[step:], step * 4
                off, flat = gather(bounds, tokens, now)
                place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                both = np.add.reduceat(mine[place] == flat, off[:-1], dtype=np.int64)
                for j in now[(100 + percent) * both >= percent * (n[now] + n[me])].tolist():
                    if find(comp[j]) != find(comp[me]):
                        root[find(comp[j])] = find(comp[me])
                        a.append(node[me])
                        b.append(node[j])
                own = find(comp[me])
                rest = rest[[find(c) != own for c in comp[rest].tolist()]]
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return {"a": np.minimum(a, b), "b": np.maximum(a, b)}


def cell_survivors(key, probe, node, n, label, point, bounds, tokens, percent):
    """The rows of a cell that have a partner in another component which the bound allows."""
    at, ask = np.flatnonzero(~probe), np.flatnonzero(probe)
    tree = RTree(n[at], point[at])
    keep = np.zeros(len(node), bool)
    for start in range(0, len(ask), 64):
        part = ask[start : start + 64]
        q, x = tree.search(n[part], point[part], percent)
        q, x = part[q], at[x]
        new = label[q] != label[x]
        keep[q[new]] = keep[x[new]] = True
    m = int(keep.sum())
    return {**{k: np.full(m, v) for k, v in zip(("token", "i", "p"), key, strict=True)}, "probe": probe[keep], "node": node[keep], "n": n[keep], "label": label[keep]}


def cells(work, percent: int):
    """For mapInArrow over rows sorted by cell (token, i, p): work's columns for each cell, whose rows may span batches."""
    types = {"token": "int64", "i": "int32", "p": "int32", "probe": "bool_", "node": "int64", "n": "int64", "label": "int64", "a": "int64", "b": "int64"}

    def run(batches):
        import pyarrow as pa

        def of(key, parts):
            probe, node, n, label, point, sizes, tokens = (np.concatenate(x) for x in zip(*parts, strict=True))
            if probe.all() or not probe.any():
                return {}
            return work(key, probe, node, n, label, point, np.concatenate(([0], np.cumsum(sizes))), tokens, percent)

        def sent(out):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out]), getattr(pa, types[c])()) for c in out[0]], names=list(out[0]))

        held, last, out, size = [], None, [], 0
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            points = batch.column("point").flatten().to_numpy().reshape(len(batch), -1)
            if "tokens" in batch.schema.names:
                sizes, flat = batch.column("tokens").value_lengths().to_numpy().astype(np.int64), batch.column("tokens").flatten().to_numpy()
            else:
                sizes, flat = np.zeros(len(batch), np.int64), np.zeros(0, np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            columns = (batch.column("probe").to_numpy(zero_copy_only=False), *(batch.column(c).to_numpy() for c in ("node", "n", "label")), points, sizes)
            edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1), [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                now = tuple(keys[a].tolist())
                if last is not None and now != last:
                    if found := of(last, held):
                        out.append(found)
                        size += len(found[next(iter(found))])
                    held = []
                    if size > 50_000:
                        yield sent(out)
                        out, size = [], 0
                last = now
                held.append((*(c[a:b] for c in columns), flat[starts[a] : starts[b]]))
        if held and (found := of(last, held)):
            out.append(found)
        if out:
            yield sent(out)

    return run


def tree_links(postings: DataFrame, lists: DataFrame, labels: DataFrame, found: DataFrame, scratch: Scratch, percent: int, cell: int = 1024) -> DataFrame:
    """(a, b), verified: links between components that an R-tree over each open list's points finds, as many as join what they link. The
    queries are the nodes outside the list's largest component; a long list is dealt into cells of about `cell` nodes and as many queries."""
    at = postings.join(lists, "token").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    at = at.withColumns({"icuts": F.ceil(F.col("nodes") / cell).cast("int"), "pcuts": F.ceil(F.col("probes") / cell).cast("int")})
    mine = lambda salt, cuts: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(cuts)).cast("int")
    index = at.select("token", mine(1, "icuts").alias("i"), F.explode(F.sequence(F.lit(0), F.col("pcuts") - 1)).alias("p"), F.lit(False).alias("probe"), "node", "label")
    probes = at.where("label <> top").select("token", F.explode(F.sequence(F.lit(0), F.col("icuts") - 1)).alias("i"), mine(2, "pcuts").alias("p"), F.lit(True).alias("probe"), "node", "label")
    key = ["token", "i", "p"]
    dealt = index.union(probes).join(found.select("node", "n", "point"), "node")
    dealt = dealt.select(*key, "probe", "node", "n", "label", "point").repartition(*key).sortWithinPartitions(*key)
    # first on points alone: only what has a partner that the bound allows brings its shingles
    left = scratch.write(dealt.mapInArrow(cells(cell_survivors, percent), "token long, i int, p int, probe boolean, node long, n long, label long"), "cells")
    full = left.join(found.select("node", "point", "tokens"), "node")
    full = full.select(*key, "probe", "node", "n", "label", "point", "tokens").repartition(*key).sortWithinPartitions(*key)
    return full.mapInArrow(cells(cell_links, percent), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, groups: int = GROUPS, tokens_a_range: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row a row of docs.

    Two texts link when 100 * intersection >= percent * union of their sets of `width`-word shingles; component_id is the smallest doc_id
    reachable by links, itself included. Null or blank texts have an empty set, link with nothing and are their own component. Rows that
    share a doc_id are rows like others. A null doc_id is never the smallest; a component without other ids has null. Empty
    tables give no rows; other columns are ignored. Sets are told apart by 64-bit fingerprints, shingles by 64-bit hashes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = scratch.write(fingerprints(docs, id_col, text_col, width), "rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    ranges = power_of_two(max(8, total / tokens_a_range))
    found = scratch.write(candidates(shared_shingles(docs, text_col, width, ranges, ranges), percent, groups), "found")
    scratch.free_shuffles()
    postings = found.select("node", F.explode("prefix").alias("token"))
    firsts = postings.groupBy("token").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("last > first")
    firsts = scratch.write(firsts.select("token", "first"), "firsts")
    stars = postings.join(firsts, "token").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    stars = scratch.write(stars, "stars")
    links = scratch.write(verified(stars, found, percent), "links")
    labels = components(links, scratch, "once")
    lists = open_lists(postings, labels, scratch)
    hubs = scratch.write(hub_pairs(postings, lists, labels, 3), "hubs")
    more = scratch.write(verified(hubs, found, percent), "hub-links")
    if not more.isEmpty():  # where nothing new links, components and open lists stay as they are
        labels = joined_components(labels, more, scratch, "twice")
        lists = open_lists(postings, labels, scratch, "still-open")
    more = scratch.write(tree_links(postings, lists, labels, found, scratch, percent), "more")
    if not more.isEmpty():
        labels = joined_components(labels, more, scratch, "labels")
    scratch.drop("found", "cells", "stars", "hubs", "firsts", "open", "still-open")
    scratch.free_shuffles()

    nodes = scratch.write(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")), "nodes")
    smallest = scratch.write(nodes.groupBy("label").agg(F.min("least").alias("component_id")), "smallest")
    named = scratch.write(nodes.join(smallest, "label").select("node", "component_id"), "named")
    linked = rows.where("n > 0").join(named, "node").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return linked.union(rows.where("n = 0").select(F.col("doc_id").alias(id_col), "n", "doc_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose id is its component's smallest; of rows that share an id, those of its component. Rows with a null
    id stay, since nothing tells them apart."""
    id_col = options.get("id_col", "doc_id")
    named = jaccard_components(docs, **options)
    keep = named.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    return docs.where(F.col(id_col).isNull()).unionByName(docs.join(keep, id_col, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns)))


def op8_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))

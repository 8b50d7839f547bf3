"""Media columns: copies of images by local descriptors.

Images are values of a binary column in the portable graymap format (P5). Corners are found at several scales; the patch around each is turned
by its own orientation and compared at fixed pairs of places, which makes 256 bits. The keys of the hash tables have two corners each: words of
32 bits of a corner and of one of its nearest corners of the same scale. A join on them, under the condition that the two corners also lie alike (distance by scale,
direction and turn, relative to the first), brings together images that share a pair of corners; a chance match would need two corners that look
alike in one arrangement. For such images all corners are compared by Hamming distance, and the matches vote for the turn, scale and shift
between the two. Images with enough votes for one such motion are copies, cropped, turned, scaled or relit.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

TURNS, RADIUS, STEP, RESPONSE = 32, 7, 2**0.5, 1.0
#: Pixels of images and corners that are described at once: bounds of a task's memory.
PIXELS, AT_ONCE = 1 << 18, 1 << 12
#: Words of a descriptor that keys are made of, each of the first BITS of 32 tests; least certain bits of each that a query flips; nearest corners that a corner is paired with,
#: and how far they are at least; pixels of a level within which a corner in a pair is the strongest.
WORDS, BITS, LOW, NEAR, LEAST, ALONE = 4, 28, 4, 3, 7, 3
#: Of 256 bits; at 26 images of 64 x 64 that have nothing to do with each other share no motion (one pair of 4,950 has 3 votes), at 48 most share one of four votes.
LIMIT, VOTES = 26, 4
#: How far apart the shapes of a pair may be: distance in 1/16 octaves, direction in 1/256 turns, turn in steps.
FAR, ASIDE, TWIST = 5, 20, 3
CORNER = np.dtype([("x", "<i4"), ("y", "<i4"), ("turn", "u1"), ("level", "u1"), ("strong", "u1"), ("none", "u1"), ("bits", "<u8", 4)])
#: Shares of the query's size in the found image: width of a bin of its middle, and how far matches may be from the motion fitted in each round.
BIN, FITS = 0.4, (0.2, 0.08, 0.03, 0.01)


def pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def read_pgm(raw: bytes | None) -> np.ndarray | None:
    """The pixels, or None for what isn't a graymap of one byte a pixel."""
    head = (raw or b"").split(None, 4)
    try:
        width, height = int(head[1]), int(head[2])
        pixels = raw[raw.index(head[3], raw.index(head[2], raw.index(head[1], 2) + len(head[1])) + len(head[2])) + len(head[3]) + 1 :]
        if head[0] != b"P5" or head[3] != b"255" or len(pixels) < width * height or width * height == 0:
            return None
        return np.frombuffer(pixels, np.uint8, width * height).reshape(height, width)
    except (IndexError, ValueError):
        return None


@lru_cache(maxsize=1)
def tests() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places by turn, as (TURNS, 256, 4); the disc's places, for the orientation."""
    rng = np.random.default_rng(11)
    places = np.clip(rng.normal(0, RADIUS / 2.2, (256, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
    angle = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(angle), -np.sin(angle)], 1), np.stack([np.sin(angle), np.cos(angle)], 1)], 1)
    turned = np.rint(np.einsum("tij,npj->tnpi", turn, places)).astype(int)
    y, x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    disc = np.stack([y[x * x + y * y <= RADIUS**2], x[x * x + y * y <= RADIUS**2]])
    return turned.reshape(TURNS, 256, 4), disc[0], disc[1]


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2r + 1, edges repeated; a: (n, height, width)."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(a, pad, "edge"), axis, dtype=np.float64)
        n = a.shape[axis]
        a = (np.take(c, np.arange(2 * r + 1, 2 * r + 1 + n), axis) - np.take(c, np.arange(n), axis)) / (2 * r + 1)
    return a


def shrink(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return a
    h, w = (max(1, int(s / scale)) for s in a.shape[1:])
    a = box(a, max(1, round(scale / 2)))
    return a[:, np.minimum((np.arange(h) * scale + scale / 2 - 0.5).round().astype(int), a.shape[1] - 1)][:, :, np.minimum((np.arange(w) * scale + scale / 2 - 0.5).round().astype(int), a.shape[2] - 1)]


def most_within(score: np.ndarray, r: int) -> np.ndarray:
    """The greatest value within r in both directions; score: (n, height, width)."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        score = np.lib.stride_tricks.sliding_window_view(np.pad(score, pad, constant_values=-np.inf), 2 * r + 1, axis).max(-1)
    return score


def describe_images(images: np.ndarray, low: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, corners, low): all corners above RESPONSE of images of one size, as CORNER, and the image that each is in; with `low`, the masks of the LOW bits of
    each word whose comparison was closest, (n, WORDS, LOW). Places are in full-size pixels; `strong` corners are the strongest within ALONE pixels of their level."""
    pairs, dy, dx = tests()
    owner, out, unsure = [np.zeros(0, int)], [np.zeros(0, CORNER)], [np.zeros((0, WORDS, LOW), np.uint32)]
    # levels go on as long as a patch fits
    for level in range(1 + int(np.log(min(images.shape[1:])) / np.log(STEP))):
        scale = STEP**level
        a = box(shrink(images.astype(np.float64), scale), 1)
        n, h, w = a.shape
        edge = RADIUS + 1
        if h <= 2 * edge + 2 or w <= 2 * edge + 2:
            continue
        gy, gx = np.gradient(a, axis=(1, 2))
        xx, yy, xy = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
        score = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = score[:, edge : h - edge, edge : w - edge]
        best = inner > RESPONSE
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                if i or j:
                    best &= inner >= score[:, edge + i : h - edge + i, edge + j : w - edge + j]
        alone = inner >= most_within(score, ALONE)[:, edge : h - edge, edge : w - edge]
        images_of, ys, xs = np.nonzero(best)
        strong = alone[images_of, ys, xs]
        for i in range(0, len(ys), AT_ONCE):
            image, y, x = images_of[i : i + AT_ONCE], ys[i : i + AT_ONCE] + edge, xs[i : i + AT_ONCE] + edge
            patch = a[image[:, None], y[:, None] + dy, x[:, None] + dx]
            angle = np.arctan2((patch * dy).sum(1), (patch * dx).sum(1))
            turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
            p = pairs[turn]
            # pairs hold (x, y) of either place, turned
            gap = a[image[:, None], y[:, None] + p[:, :, 3], x[:, None] + p[:, :, 2]] - a[image[:, None], y[:, None] + p[:, :, 1], x[:, None] + p[:, :, 0]]
            part = np.zeros(len(image), CORNER)
            part["x"], part["y"], part["turn"], part["level"], part["strong"] = np.rint(x * scale), np.rint(y * scale), turn, level, strong[i : i + AT_ONCE]
            part["bits"] = np.packbits(gap > 0, axis=1).view("<u8")
            owner.append(image)
            out.append(part)
            if low:
                closest = np.argsort(np.abs(gap).reshape(-1, 8, 32)[:, :WORDS, :BITS], axis=2, kind="stable")[:, :, :LOW]
                # bits are big-endian within bytes, bytes are little-endian within words
                unsure.append(np.uint32(1) << (closest // 8 * 8 + 7 - closest % 8).astype(np.uint32))
    return np.concatenate(owner), np.concatenate(out), np.concatenate(unsure)


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def descriptors(images: DataFrame, id_col: str = "id", image_col: str = "image", *, low: bool = False) -> DataFrame:
    """(id, width, height, corners), one row a readable image: corners is an array of CORNER as bytes, empty for images that are too small or too smooth; with `low`, for queries, also
    the masks of each word's least certain bits. Null or unreadable images have no row; ids of any type, null ones too, and repeated rows are taken as they are; other columns are ignored."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            by_size: dict = {}
            for i, raw in enumerate(batch.column(1).to_pylist()):
                image = read_pgm(raw)
                if image is not None:
                    by_size.setdefault(image.shape, []).append((i, image))
            for (height, width), same in by_size.items():
                step = max(1, PIXELS // same[0][1].size)
                for a in range(0, len(same), step):
                    part = same[a : a + step]
                    image, corners, unsure = describe_images(np.stack([p for _, p in part]), low)
                    order = np.argsort(image, kind="stable")
                    edges = np.searchsorted(image[order], np.arange(len(part) + 1)).tolist()
                    cut = lambda x: pa.array([x[order[i:j]].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())  # noqa: B023, E731
                    sides = [pa.array(np.full(len(part), n), pa.int32()) for n in (width, height)]
                    columns = [batch.column(0).take(pa.array([i for i, _ in part])), *sides, cut(corners), *([cut(unsure)] if low else [])]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "width", "height", "corners", *["low"] * low])

    own = images.where(F.col(image_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(image_col).alias("image"))
    return own.mapInArrow(run, f"id {kind_of(own, 'id')}, width int, height int, corners binary" + ", low binary" * low)


def nearest(places: np.ndarray, n: int, least: float, at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each place a with its n nearest that are at least `least` away, or with fewer."""
    firsts, seconds = [np.zeros(0, int)], [np.zeros(0, int)]
    step = max(1, at_once // max(1, len(places)))
    for a in range(0, len(places), step):
        gap = ((places[a : a + step, None] - places[None]) ** 2).sum(2)
        gap[gap < least * least] = np.inf
        b = np.argpartition(gap, n - 1, axis=1)[:, :n] if len(places) > n else np.tile(np.arange(len(places)), (len(gap), 1))
        i, k = np.nonzero(np.isfinite(np.take_along_axis(gap, b, 1)))
        firsts.append(i + a)
        seconds.append(b[i, k])
    return np.concatenate(firsts), np.concatenate(seconds)


def pair_keys(corners: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, shapes) of the pairs of a strong corner and one of its nearest, of one level. shape: distance, direction and turn, relative to the first. A corner
    has few rows, whatever the size of its image.
    With `low`, also the keys with one of either word's least certain bits flipped."""
    keys, shapes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    # the bits of a byte are big-endian; the last ones of a word make room for its number
    mask = np.packbits(np.arange(32) < BITS).view("<u4")[0]
    words = np.ascontiguousarray(corners["bits"]).view("<u4").reshape(len(corners), 8)[:, :WORDS] & mask | np.arange(WORDS, dtype=np.uint32) << 24
    for level in np.unique(corners["level"]).tolist():
        own = np.flatnonzero((corners["level"] == level) & (corners["strong"] == 1))
        place = np.stack([corners["x"][own], corners["y"][own]], 1) / STEP**level
        a, b = nearest(place, NEAR, LEAST)
        if not len(a):
            continue
        d = place[b] - place[a]
        turn = corners["turn"][own].astype(int)
        far = np.clip(np.rint(16 * np.log2(np.maximum(np.hypot(d[:, 0], d[:, 1]), 1))), 0, 255).astype(int)
        way = (np.rint(np.arctan2(d[:, 1], d[:, 0]) / (2 * np.pi) * 256).astype(int) - turn[a] * (256 // TURNS)) % 256
        shape = far | way << 8 | (turn[b] - turn[a]) % TURNS << 16
        first, second = words[own[a]][:, :, None], words[own[b]][:, :, None]
        if low is not None:
            first, second = (np.concatenate([w, w ^ low[own[i]]], 2) for w, i in ((first, a), (second, b)))
        key = first.astype(np.uint64)[:, :, :, None] << np.uint64(32) | second.astype(np.uint64)[:, :, None, :]
        keys.append(key.reshape(-1).view(np.int64))
        shapes.append(np.repeat(shape.astype(np.int32), key[0].size))
    return np.concatenate(keys), np.concatenate(shapes)


def key_rows(described: DataFrame, at_once: int = 1 << 18) -> DataFrame:
    """(id, key, shape) of a result of descriptors()."""
    probes = "low" in described.columns

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def sent():
            ids = held[0][0].take(pa.array(np.zeros(len(held[0][1]), int))) if len(held) == 1 else pa.concat_arrays([i.take(pa.array(np.zeros(len(k), int))) for i, k, _ in held])
            return pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([k for _, k, _ in held])), pa.array(np.concatenate([s for _, _, s in held]))], names=["id", "key", "shape"])

        for batch in batches:
            for i in range(len(batch)):
                corners = np.frombuffer(batch.column(1)[i].as_py(), CORNER)
                low = np.frombuffer(batch.column(2)[i].as_py(), np.uint32).reshape(-1, WORDS, LOW) if probes else None
                keys, shapes = pair_keys(corners, low)
                if len(keys):
                    held.append((batch.column(0).slice(i, 1), keys, shapes))
                    size += len(keys)
                if size >= at_once:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    return described.select("id", "corners", *["low"] * probes).mapInArrow(run, f"id {kind_of(described, 'id')}, key long, shape int")


def consensus(q: np.ndarray, f: np.ndarray, width: int, height: int, limit: int, votes: int) -> int:
    """How many corners of a query of that size go with corners of the found image under one turn, scale and shift; 0 if under `votes`.

    Matches are dealt into coarse bins of turn, scale and the place of the query's middle, relative to its size, that overlap by half, so that no motion is split by
    a bin's edge. In each bin a motion is fitted by least squares to the matches and again to those near it."""
    qi, fi = [np.zeros(0, int)], [np.zeros(0, int)]
    step = max(1, (1 << 18) // max(1, len(f)))
    for a in range(0, len(q), step):
        i, j = np.nonzero(np.bitwise_count(q["bits"][a : a + step, None] ^ f["bits"][None]).sum(2, dtype=np.int32) <= limit)
        qi.append(i + a)
        fi.append(j)
    qi, fi = np.concatenate(qi), np.concatenate(fi)
    if len(np.unique(qi)) < votes:
        return 0
    q, f = q[qi], f[fi]
    x, y, qx, qy = (c.astype(float) for c in (f["x"], f["y"], q["x"], q["y"]))
    steps, turned = f["level"].astype(int) - q["level"], (f["turn"].astype(int) - q["turn"]) % TURNS
    angle, ratio, dx, dy = turned * (2 * np.pi / TURNS), STEP**steps, width / 2 - qx, height / 2 - qy
    mx, my = x + ratio * (np.cos(angle) * dx - np.sin(angle) * dy), y + ratio * (np.sin(angle) * dx + np.cos(angle) * dy)
    size = max(width, height)
    rows = []
    for s in (steps, steps - 1):  # two neighbouring steps share a bin, whose scale is between them
        w = size * STEP ** (s + 0.5) * BIN
        for h in (0, 1):
            for i in (0, 1):
                for j in (0, 1):
                    rows.append(np.stack([s, np.full(len(s), h * 4 + i * 2 + j), (turned + 2 * h) % TURNS // 4, np.floor(mx / w + i / 2), np.floor(my / w + j / 2)], 1).astype(int))
    bins, back, count = np.unique(np.concatenate(rows), axis=0, return_inverse=True, return_counts=True)
    order = np.argsort(back.ravel(), kind="stable") % len(qi)
    edge = np.concatenate(([0], np.cumsum(count)))
    best = 0
    for k in np.argsort(-count, kind="stable").tolist():
        if count[k] <= max(best, votes - 1):
            break
        own = order[edge[k] : edge[k + 1]]
        scale = STEP ** (bins[k, 0] + 0.5)
        near, a, b = np.ones(len(own), bool), 0.0, 0.0
        for share in FITS:
            if near.sum() < 2:
                break
            u, v, s, t = (c[own[near]] for c in (qx, qy, x, y))
            m = [c.mean() for c in (u, v, s, t)]
            spread = ((u - m[0]) ** 2 + (v - m[1]) ** 2).sum()
            if spread < 1e-6:
                near[:] = False
                break
            # x = a q_x - b q_y + .., y = b q_x + a q_y + ..
            a = ((u - m[0]) * (s - m[2]) + (v - m[1]) * (t - m[3])).sum() / spread
            b = ((u - m[0]) * (t - m[3]) - (v - m[1]) * (s - m[2])).sum() / spread
            gx, gy = qx[own] - m[0], qy[own] - m[1]
            off = np.hypot(x[own] - m[2] - a * gx + b * gy, y[own] - m[3] - b * gx - a * gy)
            near = off <= max(3.0, size * scale * share)
        if scale / 1.6 <= np.hypot(a, b) <= scale * 1.6:
            best = max(best, len(np.unique(qi[own[near]])))
    return best if best >= votes else 0


def agreed(pairs: DataFrame, limit: int, votes: int) -> DataFrame:
    """(query, found, votes) of the rows (query, width, height, asked, found, corners) whose images agree in one motion."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            width, height, asked, corners = (batch.column(c) for c in ("width", "height", "asked", "corners"))
            n = np.array([consensus(np.frombuffer(asked[i].as_py(), CORNER), np.frombuffer(corners[i].as_py(), CORNER), width[i].as_py(), height[i].as_py(), limit, votes) for i in range(len(batch))], np.int64)
            keep = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([batch.column("query").filter(keep), batch.column("found").filter(keep), pa.array(n[n > 0])], names=["query", "found", "votes"])

    return pairs.mapInArrow(run, f"query {kind_of(pairs, 'query')}, found {kind_of(pairs, 'found')}, votes long")


def candidates(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(query, found, hits): the images that share a key with a query, its pair of corners in one arrangement."""
    asked, own = key_rows(queries).withColumnsRenamed({"id": "query", "shape": "q_shape"}), key_rows(base).withColumnRenamed("id", "found")
    part = lambda c, shift, bits: F.shiftright(F.col(c), shift).bitwiseAND((1 << bits) - 1)
    around = lambda shift, bits: F.least(F.pmod(part("q_shape", shift, bits) - part("shape", shift, bits), F.lit(1 << bits)), F.pmod(part("shape", shift, bits) - part("q_shape", shift, bits), F.lit(1 << bits)))
    alike = (F.abs(part("q_shape", 0, 8) - part("shape", 0, 8)) <= FAR) & (around(8, 8) <= ASIDE) & (around(16, 5) <= TWIST)
    # the planner takes keys for as few as images, so it must not weigh a broadcast
    met = asked.hint("merge").join(own, "key").where(alike)
    return met.groupBy("query", "found").agg(F.count(F.lit(1)).alias("hits"))


def copies(queries: DataFrame, base: DataFrame, *, limit: int = LIMIT, votes: int = VOTES, scratch: Scratch | None = None) -> DataFrame:
    """(query, found, votes): the images of base that a query is an edited copy of. base: a result of descriptors(); queries: one with `low`. Of rows
    that share an id the best counts; null ids are never found, and an empty side gives no rows.

    A query's pair of corners probes its own keys and those with one of either word's LOW least certain bits flipped: long keys keep chance matches rare, probes on the small
    side find what noise has changed. Keys alike in all their bits and in the arrangement of their corners are so rare by chance that what the join gives follows the true matches, at any
    size of base, and nothing depends on how many corners share a word. What is found by one key or more is compared in full: no cap on candidates, and none on corners."""
    scratch = scratch or Scratch(base.sparkSession, "copies")
    found = scratch.write(candidates(queries, base), "candidates")
    asked = queries.select(F.col("id").alias("query"), "width", "height", F.col("corners").alias("asked"))
    agree = agreed(found.join(asked, "query").join(base.select(F.col("id").alias("found"), "corners"), "found"), limit, votes)
    return agree.groupBy("query", "found").agg(F.max("votes").alias("votes"))


def classes(images: DataFrame, scratch: Scratch, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """(id, class_id): equal images (by two 64-bit hashes) are one class, named by its smallest id. Null images are classes of their own."""
    rows = images.select(F.col(id_col).alias("id"), F.xxhash64(image_col).alias("h"), F.xxhash64(F.lit(9), image_col).alias("g"), F.col(image_col).isNull().alias("none"))
    rows = scratch.write(rows, "hashes")
    least = scratch.write(rows.where("not none").groupBy("h", "g").agg(F.min("id").alias("class_id")), "classes")
    return rows.where("not none").join(least, ["h", "g"]).select("id", "class_id").union(rows.where("none").select("id", "id"))


def render(vectors: np.ndarray, size: int = 64) -> np.ndarray:
    """An image for each vector: rectangles under a coarse grain, all drawn by a generator that the vector seeds. Equal vectors give equal images."""
    import hashlib

    out = np.full((len(vectors), size, size), 128.0)
    for image, v in zip(out, vectors, strict=True):
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(np.ascontiguousarray(v, np.float32).tobytes()).digest()[:8], "little"))
        at, span, tone = rng.integers(0, size - 6, (24, 2)), rng.integers(6, 22, (24, 2)), rng.integers(70, 186, 24)
        for (y, x), (h, w), t in zip(at.tolist(), span.tolist(), tone.tolist(), strict=True):
            image[y : y + h, x : x + w] = t
        image += np.kron(rng.normal(0, 30, (-(-size // 3), -(-size // 3))), np.ones((3, 3)))[:size, :size]
    return np.clip(box(out, 1), 0, 255).astype(np.uint8)


def edited(image: np.ndarray, i: int) -> np.ndarray:
    """A copy cut down to 52 of 64 rows and columns, relit, and turned by a right angle for every second id."""
    cut = image.shape[0] * 13 // 16
    y, x = (i // 20 * 7) % (image.shape[0] - cut + 1), (i // 20 * 5) % (image.shape[1] - cut + 1)
    out = (image[y : y + cut, x : x + cut] * 0.85 + 12).astype(np.uint8)
    return np.ascontiguousarray(np.rot90(out)) if i // 20 % 2 else out


def rendered(df: DataFrame, edit: bool = False) -> DataFrame:
    """(id, image) of (id, embedding); null embeddings give null images."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            images = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = None if v is None else render(np.array([[0.0 if y is None else y for y in v]], np.float32))[0]
                images.append(None if image is None else pgm(edited(image, i) if edit else image))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], names=["id", "image"])

    return df.select(F.col("vec_id").cast("long").alias("id"), "embedding").mapInArrow(run, "id long, image binary")


def op10_media(spark, sf_dir):
    """Images drawn from all embeddings. Queries are edited copies of the rows whose id is divisible by 20 (one of each class), searched among all classes.
    Rows: kind 'member' with vec_id and its class_id; kind 'pair' with the query's class_id in vec_id, the class found, and votes."""
    scratch = Scratch(spark, "media")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # an image follows from its vector, so that equal vectors are equal images; images are drawn where they are described, and never stored
    member = scratch.write(classes(vectors, scratch, "vec_id", "embedding"), "members")
    asked = member.where("id % 20 = 0").select(F.col("class_id").alias("id")).distinct()
    heads = member.where("id = class_id").select(F.col("id").alias("vec_id"))
    base = scratch.write(descriptors(rendered(vectors.join(heads, "vec_id", "left_semi"))), "base")
    queries = vectors.join(asked.withColumnRenamed("id", "vec_id"), "vec_id", "left_semi")
    found = copies(scratch.write(descriptors(rendered(queries, edit=True), low=True), "queries"), base, scratch=scratch)
    members = member.select(F.lit("member").alias("kind"), F.col("id").alias("vec_id"), "class_id", F.lit(None).cast("long").alias("votes"))
    return members.union(found.select(F.lit("pair"), "query", "found", "votes"))

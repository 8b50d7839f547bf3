"""Exact top-k over many candidates that looks at few: metric balls, impact-ordered posting blocks, centroids of token vectors.

Each has an index with an upper bound for what a part of it can score. What the first look finds gives each query a threshold, its k-th score so far, and only parts whose bound reaches it are looked
at. Bounds are widened by a little, so that rounding never leaves out a tie.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .ranking import _schema, multiplied, tiled_top_k, top_k

#: By how much bounds are widened, relative to the lengths of the vectors: far more than a sum of doubles is off.
SLACK = 1e-9


@dataclass
class Work:
    """What a search did: `looked` at of `all` (pairs, or products), for tests and reports."""

    looked: int = 0
    all: int = 0
    rounds: list[int] = field(default_factory=list)


def _distinct(vectors: list) -> np.ndarray:
    return np.unique(np.array(vectors, dtype=np.float64), axis=0) if vectors else np.zeros((0, 0))


def _pivots(c: DataFrame, n: int) -> np.ndarray:
    """n vectors, those with the smallest hashes of their ids: a bounded sample."""
    rows = c.orderBy(F.xxhash64("c_id"), "c_id").limit(n).select("cv").collect()
    return _distinct([r["cv"] for r in rows])


def _nearest(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, distance to it) of each vector."""
    near = ((vectors**2).sum(1)[:, None] - 2 * vectors @ pivots.T + (pivots**2).sum(1)[None]).argmin(1)
    return near, np.sqrt(((vectors - pivots[near]) ** 2).sum(1))


def _slices(pdf: pd.DataFrame, step: int):
    """Some rows at a time."""
    for a in range(0, len(pdf), step):
        yield pdf.iloc[a : a + step]


def metric_top_k(q: DataFrame, c: DataFrame, k: int, *, pivots: int | None = None, tile: int = 20_000, part: int = 10_000, open_tiles: int = 64, open_share: float = 1 / 4, work: Work | None = None) -> DataFrame:
    """(q_id, c_id, sim, rank), as ranking.tiled_top_k gives it: the k candidates with the greatest dot products, ties by c_id; and c_row if c has it.

    Candidates lie in balls around pivots, a bounded sample of them; a ball is cut into rings by distance, and a ring of more than `tile` candidates by hash, so that a tile is a bounded group
    however many share a ball. For a query and a tile, q.p + |q| r and |q| times the greatest length bound every product. Each round a query is multiplied with the tiles of the
    greatest bounds that it hasn't met, once, then 4, 16, ... at a time, as long as they reach its k-th score. Candidates move to their tile's task in the rounds that ask
    for it, once for each `part` queries that do. A query to which more than `open_tiles` tiles with more than `open_share` of all candidates are left after two rounds is multiplied with all by
    ranking.tiled_top_k instead: bounds leave out little for it, and its vector would go to each of those tiles. Bounds and asks are made for some queries at once. The driver holds the pivots and a few numbers a tile: 65,536 tiles at most, above which tiles grow."""
    q, c = q.where("qv is not null").select("q_id", "qv"), c.where("cv is not null")
    n = c.count()
    scratch = Scratch(q.sparkSession, "metric")
    pivots = pivots or int(min(1024, max(1, np.sqrt(n) / 2)))
    middles = _pivots(c, pivots)
    tile, schema = max(tile, n >> 16), _schema(q, c)
    keep = [x for x in ("c_id", "c_row", "cv") if x in c.columns]
    kinds = dict(c.dtypes)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["cv"].to_numpy())
                pdf["ball"], pdf["far"] = _nearest(v, middles)
                pdf["length"] = np.sqrt((v**2).sum(1))
                yield pdf

    placed = scratch.write(c.select(*keep).mapInPandas(assign, ", ".join(f"{x} {kinds[x]}" for x in keep) + ", ball int, far double, length double"), "placed")
    # rings of a ball hold about `tile` candidates; equal distances share one, and hash parts split what is still too many
    balls = placed.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("most"))
    rings = F.greatest(F.lit(1), F.ceil(F.col("n") / tile)).cast("int")
    ring = F.least(F.col("rings") - 1, F.floor(F.col("far") / F.greatest(F.col("most"), F.lit(1e-300)) * F.col("rings"))).cast("int")
    placed = placed.join(balls.select("ball", "most", rings.alias("rings")), "ball").withColumn("ring", ring)
    sizes = placed.groupBy("ball", "ring").agg(F.ceil(F.count(F.lit(1)) / (2 * tile)).cast("int").alias("cuts"))
    placed = placed.join(sizes, ["ball", "ring"]).withColumn("cut", F.pmod(F.xxhash64("c_id"), F.col("cuts")).cast("int"))
    placed = scratch.write(placed.select(*keep, "ball", "ring", "cut", "far", "length"), "tiles")
    stats = placed.groupBy("ball", "ring", "cut").agg(F.max("far").alias("far"), F.max("length").alias("length"), F.count(F.lit(1)).alias("n")).orderBy("ball", "ring", "cut").toPandas()
    ball, far, longest, sized = (stats[x].to_numpy() for x in ("ball", "far", "length", "n"))
    # typed as asks are: an int and a long of one value hash to different tasks
    tiles = q.sparkSession.createDataFrame([(i, *map(int, x)) for i, x in enumerate(stats[["ball", "ring", "cut"]].to_numpy())], "tile int, ball int, ring int, cut int") if len(stats) else None
    if work is not None:
        work.all = n * q.count()
    nothing = top_k(q.sparkSession.createDataFrame([], schema), k)
    if tiles is None:
        return nothing
    placed = placed.join(F.broadcast(tiles), ["ball", "ring", "cut"]).select("tile", *keep)

    def bounds(v: np.ndarray) -> np.ndarray:
        own = np.sqrt((v**2).sum(1))[:, None]
        reach = np.minimum((v @ middles.T)[:, ball] + own * far[None], own * longest[None])
        return reach + SLACK * own * (longest[None] + 1)

    found, whole, begin, size = None, None, 0, 1
    while begin < len(ball):
        done = min(len(ball), begin + size)

        def ask(batches, begin=begin, done=done, sort=begin >= 5 and whole is None):
            for pdf in batches:
                for some in _slices(pdf, max(1, min(1_000_000 // len(ball), 20_000 // (done - begin)))):
                    most, least = bounds(np.stack(some["qv"].to_numpy())), some["least"].fillna(-np.inf).to_numpy()[:, None]
                    order = np.argsort(-most, axis=1, kind="stable")[:, begin:]
                    reached = np.take_along_axis(most, order, 1) >= least
                    wide = (reached.sum(1) > open_tiles) & ((reached * sized[order]).sum(1) > open_share * n) if sort else np.zeros(len(some), bool)
                    rows, columns = np.nonzero(reached[:, : done - begin] & ~wide[:, None])
                    rows, tile_of = np.concatenate([rows, np.flatnonzero(wide)]), np.concatenate([order[rows, columns], np.full(wide.sum(), -1)])
                    yield pd.DataFrame({"q_id": some["q_id"].to_numpy()[rows], "qv": some["qv"].to_numpy()[rows], "tile": tile_of.astype("int32")})

        if found is None:
            known = q.withColumn("least", F.lit(None).cast("double"))
        else:
            least = found.groupBy("q_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("least"))
            known = q.join(least, "q_id", "left")
        kinds_q = dict(q.dtypes)
        asks = scratch.write(known.mapInPandas(ask, f"q_id {kinds_q['q_id']}, qv {kinds_q['qv']}, tile int"), f"asks{begin}")
        met = {r["tile"]: r["n"] for r in asks.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number a tile
        wide = met.pop(-1, 0)
        if begin >= 5 and whole is None:
            whole = nothing
            if wide:
                alone = asks.where("tile = -1")
                whole = tiled_top_k(alone.select("q_id", "qv"), c, k)
                named = alone.select(F.col("q_id").alias("_wide"))
                q, found = (df.join(named, df["q_id"].eqNullSafe(named["_wide"]), "left_anti") for df in (q, found))
                q = scratch.write(q, "narrow")
        if work is not None:
            work.looked += wide * n
        if not met:
            break
        if work is not None:
            work.looked += int(sum(sized[t] * m for t, m in met.items()))
            work.rounds.append(sum(met.values()))
        parts = q.sparkSession.createDataFrame([(t, -(-m // part)) for t, m in met.items()], "tile int, parts int")
        left = asks.where("tile >= 0").join(F.broadcast(parts), "tile").withColumn("part", F.pmod(F.xxhash64("q_id"), F.col("parts")).cast("int")).drop("parts")
        right = placed.join(F.broadcast(parts), "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        new = left.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")).applyInPandas(lambda a, b: multiplied(a, b, k), schema)
        best = top_k(new if found is None else found.unionByName(new), k).drop("rank")
        found = scratch.write(best, f"found{begin}")
        begin, size = done, size * 4
    return nothing if found is None else top_k(found if whole is None else found.unionByName(whole.drop("rank")), k)


def _shared(asked: pd.DataFrame, base: pd.DataFrame, k: int, other_than_itself: bool) -> pd.DataFrame:
    """(q_id, c_id, sparse) of the k best candidates of each query of a group, ties by c_id, from rows (q_id, token, wq) and (c_id, token, wc): postings by token, and one sum a candidate for each query."""
    nothing = pd.DataFrame({"q_id": asked["q_id"][:0], "c_id": base["c_id"][:0], "sparse": np.zeros(0)})
    if asked.empty or base.empty:
        return nothing
    who, ids = pd.factorize(base["c_id"], sort=True)
    codes, words = pd.factorize(base["token"])
    order = np.argsort(codes, kind="stable")
    who, weight = who[order], base["wc"].to_numpy()[order]
    begin = np.searchsorted(codes[order], np.arange(len(words) + 1))
    asked = asked.assign(code=pd.Index(words).get_indexer(asked["token"]))
    asked = asked[asked["code"] >= 0]
    places, out = pd.Index(ids), []
    for q_id, own in asked.groupby("q_id", sort=False):
        code = own["code"].to_numpy()
        size = begin[code + 1] - begin[code]
        at = np.arange(size.sum()) + np.repeat(begin[code] - np.cumsum(size) + size, size)
        met = who[at]
        sums = np.bincount(met, weights=weight[at] * np.repeat(own["wq"].to_numpy(), size), minlength=len(ids))
        there = np.zeros(len(ids), bool)
        there[met] = True
        if other_than_itself and q_id in places:
            there[places.get_loc(q_id)] = False
        found = np.flatnonzero(there)
        if len(found) > k:
            found = found[sums[found] >= np.partition(sums[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((found, -sums[found]))[:k]]
        out.append(pd.DataFrame({"q_id": [q_id] * len(found), "c_id": np.asarray(ids)[found], "sparse": sums[found]}))
    return pd.concat(out) if out else nothing


def sparse_top_k(q: DataFrame | Column, c: DataFrame, k: int, *, on: str = "city", other_than_itself: bool = False, band: int = 10_000, part: int = 2_000, by_block: bool = False, work: Work | None = None) -> DataFrame:
    """(q_id, c_id, sparse, rank): the k candidates of a query's block with the greatest sums of weight products over shared tokens; pairs that share none have no row. q: q_id, c: c_id,
    both: block, token, weight, one row a token; or q is a condition on c_id, where candidates ask themselves. other_than_itself leaves out the candidate whose id is the query's.

    A block's candidates lie in bands by their vectors' length, four to an octave, cut by hash where one holds more than `band`: a token that all have is split by the bands. The first
    pass scores the longest candidates, k at least, and gives each query its threshold. The second looks at the bands that can reach it, by length times length, and multiplies the postings
    of those alone. by_block also bounds a band by the sum of the greatest weights that its posting blocks (band, token) have: a pass over the postings, which pays where lengths are
    alike. Postings are written once and then only read. A band and some `part` queries that look at it are one group, whose sums are made in one task: no product is shuffled, and neither postings nor
    what queries ask of them are sent to all."""
    scratch, numbers = Scratch(c.sparkSession, "sparse"), count()
    whole = lambda df, name, w: df.select(name, on, "token", F.col("weight").cast("double").alias(w)).where(F.col(on).isNotNull() & F.col("token").isNotNull() & F.col("weight").isNotNull())
    long = F.sqrt(F.sum(F.col("wc") * F.col("wc")).over(Window.partitionBy("c_id", on)))
    c = scratch.write(whole(c, "c_id", "wc").withColumn("length", long).where("length > 0").withColumn("level", F.floor(4 * F.log2("length")).cast("int")), "postings")
    q = c.where(q).select(F.col("c_id").alias("q_id"), on, "token", F.col("wc").alias("wq")) if isinstance(q, Column) else whole(q, "q_id", "wq")
    q = scratch.write(q, "queries")
    docs = c.groupBy(on, "level", "c_id").agg(F.max("length").alias("length"))
    cuts = docs.groupBy(on, "level").agg(F.ceil(F.count(F.lit(1)) / band).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("c_id"), F.col("cuts")).cast("int").alias("cut")
    # a few numbers for each band: some tens a block, and one for each `band` candidates
    bands = docs.join(F.broadcast(cuts), [on, "level"]).select(on, "level", "cuts", cut, "length").groupBy(on, "level", "cuts", "cut").agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(on).orderBy(F.desc("longest"), "level", "cut").rowsBetween(Window.unboundedPreceding, -1)
    bands = scratch.write(bands.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)) <= k), "bands")
    key = [on, "level", "cut"]

    def postings_of(some: DataFrame) -> DataFrame:
        """The postings of some bands: bands are few, and the rest of the postings ends where it is read."""
        levels = some.select(on, "level", "cuts").distinct()
        return c.join(F.broadcast(levels), [on, "level"]).select(on, "level", cut, "token", "c_id", "wc").join(F.broadcast(some.select(*key).distinct()), key, "left_semi")

    def products(asked: DataFrame, keys: list[str], among: DataFrame) -> DataFrame:
        out = asked.join(among, keys)
        return out.where("q_id <> c_id") if other_than_itself else out

    def summed(asked: DataFrame, keys: list[str], among: DataFrame) -> DataFrame:
        parts = asked.select("q_id", *keys).distinct().groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
        parts = F.broadcast(scratch.write(parts, f"parts{next(numbers)}"))  # a number for each band
        left = asked.join(parts, keys).select("q_id", "token", "wq", *keys, F.pmod(F.xxhash64("q_id"), F.col("parts")).cast("int").alias("part"))
        right = among.join(parts, keys).select("c_id", "token", "wc", *(F.col(x).alias(f"_{x}") for x in keys), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        run = lambda a, b: _shared(a, b, k, other_than_itself)
        return left.groupBy(*keys, "part").cogroup(right.groupBy(*(f"_{x}" for x in keys), "part")).applyInPandas(run, f"q_id {dict(q.dtypes)['q_id']}, c_id {dict(c.dtypes)['c_id']}, sparse double")

    # the longest candidates come by band as well: a block's first bands are no group of their own
    firsts = bands.where("first")
    asks = q.join(F.broadcast(firsts.select(*key)), on)
    found = scratch.write(top_k(summed(asks, key, postings_of(firsts)), k, "sparse").drop("rank"), "first")
    least = found.groupBy("q_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("sparse")).alias("least"))
    asked = q.groupBy("q_id", on).agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("own")).join(least, "q_id", "left")
    reach = F.col("own") * F.col("longest") * (1 + SLACK)
    open_ = asked.join(F.broadcast(bands.where("not first")), on).where(F.col("least").isNull() | (reach >= F.col("least")))
    open_ = scratch.write(open_.select("q_id", *key, "cuts", "least").join(q.hint("merge"), ["q_id", on]), "open")
    if by_block:
        blocks = postings_of(open_).groupBy(*key, "token").agg(F.max(F.abs("wc")).alias("most"))
        bound = open_.join(blocks, [*key, "token"]).groupBy("q_id", *key).agg(F.sum(F.abs("wq") * F.col("most")).alias("bound"), F.max("least").alias("most_least"))
        left = bound.where(F.col("most_least").isNull() | (F.col("bound") * (1 + SLACK) >= F.col("most_least"))).select("q_id", *key)
        open_ = scratch.write(open_.join(left, ["q_id", *key], "left_semi"), "left")
    rest = open_.select("q_id", *key, "token", "wq")
    if work is not None:
        work.rounds = [products(asks, [*key, "token"], postings_of(firsts)).count(), products(rest, [*key, "token"], postings_of(open_)).count()]
        work.looked, work.all = sum(work.rounds), products(q, [on, "token"], c).count()
    return top_k(found.unionByName(summed(rest, key, postings_of(open_))), k, "sparse")


def sparse_grouped_top_k(q: DataFrame | Column, c: DataFrame, k: int, *, on: str = "city", other_than_itself: bool = False, lead: int = 64, tile: int = 1_000, part: int = 2_000, work: Work | None = None) -> DataFrame:
    """As sparse_top_k, without Python, of entities that are rows with arrays of their own tokens and weights (q: q_id, c: c_id, both: block, token, weight); sums have the type of the weights.

    The `lead` longest of a block meet all its queries first: a query's k-th best sum of those is a threshold, and only entities whose length times the query's can reach it are met then. They lie
    in bands by length, four to an octave; some `tile` of a band and some `part` of the queries that look at it are one group of a bounded number of pairs, dealt to a task as rows of both sides
    and only there taken apart into tokens: what shares a token is multiplied and summed by pair without another exchange, so that no product is shuffled."""
    scratch, numbers = Scratch(c.sparkSession, "sparse"), count()
    shuffles = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def entities(df: DataFrame, name: str) -> DataFrame:
        length = F.sqrt(F.aggregate("weight", F.lit(0.0), lambda s, w: s + F.coalesce(w.cast("double") * w, F.lit(0.0))))
        return df.where(F.col(on).isNotNull()).select(name, on, "token", "weight", length.alias("length"))

    level = F.coalesce(F.floor(4 * F.log2("length")).cast("int"), F.lit(-10_000))  # a length of 0 has no logarithm
    c = scratch.write(entities(c, "c_id").withColumn("level", level), "entities")
    q = c.where(q).withColumnRenamed("c_id", "q_id").drop("level") if isinstance(q, Column) else scratch.write(entities(q, "q_id"), "queries")
    scratch.free_shuffles()

    def summed(asked: DataFrame, among: DataFrame) -> DataFrame:
        """(q_id, c_id, sparse) of the pairs of a block whose entity's length is at least the query's `need`."""
        bands = among.groupBy(on, "level").agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("n"))
        looks = asked.select(on, "need").join(F.broadcast(bands), on).where("longest >= need").groupBy(on, "level", "longest", "n").agg(F.count(F.lit(1)).alias("asks"))
        cut = lambda n, size: F.ceil(F.col(n) / size).cast("int")
        sizes = scratch.write(looks.select("*", cut("n", tile).alias("tiles"), cut("asks", part).alias("parts"), F.monotonically_increasing_id().alias("band")), f"bands{next(numbers)}")
        pairs = sizes.agg(F.sum(F.col("n") * F.col("asks"))).first()[0] or 0
        tasks = max(shuffles, -(-pairs // (tile * part)))
        sizes = F.broadcast(sizes.drop("n", "asks"))  # a few numbers for each band
        salt = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(sizes, on).where("longest >= need").select("band", salt("q_id", "parts").alias("part"), every("tiles").alias("tile"), "q_id", "need", "token", "weight")
        right = among.join(sizes, [on, "level"]).select("band", every("parts").alias("part"), salt("c_id", "tiles").alias("tile"), "c_id", "length", "token", "weight")
        both = left.unionByName(right, allowMissingColumns=True).repartition(tasks, "band", "part", "tile")
        flat = both.select("band", "part", "tile", "q_id", "need", "c_id", "length", F.inline(F.arrays_zip("token", "weight"))).where("token is not null and weight is not null")
        side = lambda *names: F.collect_list(F.when(F.col(names[1]).isNotNull(), F.struct(*names, "weight")))
        met = flat.groupBy("band", "part", "tile", "token").agg(side("q_id", "need").alias("asked"), side("c_id", "length").alias("held")).where("size(asked) > 0 and size(held) > 0")
        met = met.select("band", "part", "tile", "held", F.inline("asked").alias("q_id", "need", "wq")).select("band", "part", "tile", "q_id", "need", "wq", F.inline("held").alias("c_id", "length", "wc"))
        products = met.where("length >= need and q_id <> c_id" if other_than_itself else "length >= need")
        if work is not None:
            work.rounds.append(products.count())
        return products.groupBy("band", "part", "tile", "q_id", "c_id").agg(F.sum(F.col("wq") * F.col("wc")).alias("sparse")).select("q_id", "c_id", "sparse")

    longest = scratch.write(top_k(c.select("c_id", on, "length"), lead, "length", by=(on,)).select("c_id", on), "lead")
    first = summed(q.withColumn("need", F.lit(float("-inf"))), c.join(longest, ["c_id", on]).withColumn("level", F.lit(0)))
    least = scratch.write(top_k(first, k, "sparse").where(F.col("rank") == int(k)).select("q_id", F.col("sparse").cast("double").alias("least")), "least")
    need = F.coalesce(F.try_divide(F.col("least"), F.col("length") * (1 + SLACK)), F.lit(float("-inf")))
    found = summed(scratch.write(q.join(least, "q_id", "left").select("q_id", on, "token", "weight", need.alias("need")), "asked"), c)
    if work is not None:
        words = lambda df, *names: df.select(*names, F.explode("token").alias("token"))
        every = words(q, "q_id", on).join(words(c, "c_id", on), [on, "token"])
        work.looked, work.all = sum(work.rounds), (every.where("q_id <> c_id") if other_than_itself else every).count()
    return top_k(found, k, "sparse")


def _late_products(asked: list[np.ndarray], flat: np.ndarray, owner: np.ndarray, n: int, k: int, places: int):
    """(query, candidate, score) as late_scores gives them, by products of all token vectors: some queries at once, so that a few million products are held."""
    counts = np.bincount(owner, minlength=n)
    even = counts.min() == counts.max()
    slots = [np.ascontiguousarray(flat[j :: counts[0]].T) for j in range(counts[0])] if even else None
    begin, most = np.cumsum([0, *counts[:-1]]), min(k, n)
    step, out = max(1, 2_000_000 // len(flat)), []
    for a in range(0, len(asked), step):
        some = asked[a : a + step]
        vectors = np.concatenate(some)
        if even:
            best = vectors @ slots[0]
            for m in slots[1:]:
                np.maximum(best, vectors @ m, out=best)
        else:
            best = np.maximum.reduceat(vectors @ flat.T, begin, axis=1)
        score = np.add.reduceat(best, np.cumsum([0, *(len(v) for v in some[:-1])]), axis=0)
        least = np.partition(score, n - most, axis=1)[:, n - most] - 2 * 10.0**-places
        rows, columns = np.nonzero(score >= least[:, None])
        exact = np.round(score[rows, columns], places)
        order = np.lexsort((columns, -exact, rows))
        order = order[np.arange(len(order)) - np.searchsorted(rows, rows[order]) < most]
        out.append((rows[order] + a, columns[order], exact[order]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def late_scores(asked: list[np.ndarray], flat: np.ndarray, owner: np.ndarray, n: int, middles: np.ndarray, k: int, places: int = 12):
    """(query, candidate, score) of the k best candidates of each query by MaxSim, and how many pairs were scored. flat: all token vectors, owner: their candidates, 0 to n - 1, in the order of ties.

    The index holds, for each candidate and middle, how far its token vectors there are from the middle. A query vector's product with any of them is at most its product with the middle and
    its length times that distance. The sum of the best of these bounds a candidate; those with the greatest bounds are scored first, until none left can be among the k. Where the first queries' bounds leave out less than seven eighths, the other queries are multiplied with all."""
    near, far = _nearest(flat, middles)
    reach = np.full((n, len(middles)), -np.inf)
    np.maximum.at(reach, (owner, near), far)
    cells = [(g, np.flatnonzero(reach[:, g] >= 0)) for g in range(len(middles))]
    begin = np.searchsorted(owner, np.arange(n + 1))
    longest = np.sqrt((flat**2).sum(1)).max(initial=0)
    rows, scored, tried = [], 0, 8
    for i, vectors in enumerate(asked):
        if i == tried and scored > tried * n // 8:  # bounds leave out little of these entities: products of all cost less than they do
            at, held, score = _late_products(asked[i:], flat, owner, n, k, places)
            rows.append((at + i, held, score))
            scored += (len(asked) - i) * n
            break
        own, near_middle = np.sqrt((vectors**2).sum(1)), vectors @ middles.T
        best = np.full((len(vectors), n), -np.inf)
        for g, who in cells:
            best[:, who] = np.maximum(best[:, who], near_middle[:, g, None] + own[:, None] * reach[who, g][None])
        bound = best.sum(0) + SLACK * own.sum() * (longest + 1)
        order = np.argsort(-bound, kind="stable")
        held_score, held, at, least = np.zeros(0), np.zeros(0, np.int64), 0, -np.inf
        while at < n and bound[order[at]] >= least - 10.0**-places:
            some = order[at : at + max(2 * k, 16)]
            if len(held) >= k:
                some = some[bound[some] >= least - 10.0**-places]
            at += max(2 * k, 16)
            tokens = np.concatenate([np.arange(begin[j], begin[j + 1]) for j in some])
            starts = np.cumsum([0, *(begin[j + 1] - begin[j] for j in some[:-1])])
            score = np.round(np.maximum.reduceat(vectors @ flat[tokens].T, starts, axis=1).sum(0), places)
            scored += len(some)
            held_score, held = np.concatenate([held_score, score]), np.concatenate([held, some])
            keep = np.lexsort((held, -held_score))[:k]
            held_score, held = held_score[keep], held[keep]
            least = held_score[-1] if len(held) >= k else -np.inf
        rows.append((np.full(len(held), i), held, held_score))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return *(np.concatenate(x) for x in zip(empty, *rows, strict=True)), scored


def late_top_k(q: DataFrame, c: DataFrame, k: int, *, on: str = "city", middles: int = 64, tile: int = 8_000, part: int = 4_000) -> DataFrame:
    """(q_id, c_id, multi, rank, scored): the k candidates of a query's block with the greatest MaxSim, ties by c_id. q: q_id, block, qm; c: c_id, block, cm, where qm and cm are arrays of vectors.
    scored is how many full scores the group of that row computed.

    Middles are a bounded sample of token vectors. Blocks are dealt into tiles of about `tile` candidates and parts of about `part` queries; a pair of them is one group, in which bounds come before any full score. Rows
    without vectors, or without a block, are compared with nothing; ids are of any type that has an order."""
    q, c = (df.select(name, on, v).where(F.col(on).isNotNull() & (F.size(v) > 0)) for df, name, v in ((q, "q_id", "qm"), (c, "c_id", "cm")))
    sample = c.orderBy(F.xxhash64("c_id"), "c_id").limit(middles).select(F.col("cm")[F.pmod(F.xxhash64("c_id"), F.size("cm")).cast("int")].alias("v")).collect()
    points = _distinct([r["v"] for r in sample])
    # the block has a name of its own in each side, which may both come from one table
    of = lambda df, n, name: df.groupBy(F.col(on).alias("_block")).agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    dealt = of(c, tile, "tiles").join(of(q, part, "parts"), "_block")
    salt = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.withColumn("_block", F.col(on)).drop(on).join(dealt, "_block").select("q_id", "qm", F.col("_block").alias("_left"), salt("q_id", "parts").alias("_part"), every("tiles").alias("_tile"))
    right = c.withColumn("_block", F.col(on)).drop(on).join(dealt, "_block").select("c_id", "cm", F.col("_block").alias("_right"), salt("c_id", "tiles").alias("_tile"), every("parts").alias("_part"))
    kinds = (q.schema["q_id"].dataType.simpleString(), c.schema["c_id"].dataType.simpleString())

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"q_id": a["q_id"][:0], "c_id": b["c_id"][:0], "multi": np.zeros(0), "scored": np.zeros(0, np.int64)})
        b = b.sort_values("c_id", kind="stable")
        own = [np.stack(list(m)).astype(np.float64) for m in b["cm"]]
        asked = [np.stack(list(m)).astype(np.float64) for m in a["qm"]]
        rows, held, score, n = late_scores(asked, np.concatenate(own), np.repeat(np.arange(len(own)), [len(m) for m in own]), len(own), points, k)
        return pd.DataFrame({"q_id": a["q_id"].to_numpy()[rows], "c_id": b["c_id"].to_numpy()[held], "multi": score, "scored": n})

    found = left.groupBy("_left", "_part", "_tile").cogroup(right.groupBy("_right", "_part", "_tile")).applyInPandas(run, f"q_id {kinds[0]}, c_id {kinds[1]}, multi double, scored long")
    return top_k(found, k, "multi")

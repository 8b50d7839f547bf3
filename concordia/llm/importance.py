"""Target-distribution importance resampling over bucket-partitioned inverted postings.

Runs of one to three words are hashed to buckets. The postings (bucket, document, count) of a chunk of documents are packed by bucket, about a byte each, and shuffled by bucket, where they meet
the bucket's gain: what both corpora have in it, counted in each task first. A task adds up what its buckets contribute to each document, and the contributions are reduced by document.
Documents are then drawn by weight and a keyed Gumbel number: the drawn ones are ranked by ranges of scores, whose sizes add up to each range's first rank.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Bytes and rows of a chunk of documents; a longer document is a chunk by itself and read in blocks of so many bytes.
CHUNK_BYTES, CHUNK_ROWS = 1 << 22, 1024
#: Words longer than this are hashed one by one.
LONG_WORD = 48
BUCKETS, RUN = 10_000, 3


@lru_cache(maxsize=1)
def byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a byte is in lower case; whether it is of a word; the checksum's table."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[97:123] = word[128:] = True
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return lower, word, crc


@lru_cache(maxsize=LONG_WORD * 2)
def shift(n: int) -> np.ndarray:
    """How n bytes behind it change a checksum, as a table [byte of the checksum, its value]: the checksum of a text with n more bytes is this, combined with theirs."""
    _, _, crc = byte_tables()
    bits = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))

    def apply(matrix, x):  # x through a matrix of 32 images of single bits
        out = np.zeros_like(x)
        for i in range(32):
            out ^= np.where((x >> np.uint32(i)) & np.uint32(1), matrix[i], np.uint32(0))
        return out

    step, power, left = (bits >> np.uint32(8)) ^ crc[bits & np.uint32(255)], bits.copy(), n
    while left:
        if left & 1:
            power = apply(step, power)
        step = apply(step, step)
        left >>= 1
    values = np.arange(256, dtype=np.uint32)
    return np.stack([apply(power, values << np.uint32(8 * k)) for k in range(4)])


@lru_cache(maxsize=1)
def near_shifts() -> np.ndarray:
    """The tables for 0 to LONG_WORD bytes, one behind the other."""
    return np.concatenate([shift(n).ravel() for n in range(LONG_WORD + 1)])


def combined(before: np.ndarray, after: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums of texts put together, from those of both parts and the sizes of the second."""
    out = np.empty_like(before)
    near = size <= LONG_WORD
    if near.any():
        b, s = (before, size) if near.all() else (before[near], size[near])
        row = s.astype(np.uint32) << np.uint32(10)
        found = near_shifts()[row + (b & 255)]
        for k in (1, 2, 3):
            found ^= near_shifts()[row + np.uint32(256 * k) + ((b >> np.uint32(8 * k)) & 255)]
        out[near] = found ^ after[near]
    for i in np.flatnonzero(~near):
        t, b = shift(int(size[i])), int(before[i])
        out[i] = t[0, b & 255] ^ t[1, (b >> 8) & 255] ^ t[2, (b >> 16) & 255] ^ t[3, b >> 24] ^ after[i]
    return out


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, checksum, checksum with a space before it) of each word in the bytes of a text."""
    lower, word, crc = byte_tables()
    data = lower[data]
    inside = np.concatenate([[False], word[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    one = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    two = np.full(len(start), int(crc[(0xFFFFFFFF ^ 32) & 255]) ^ (0xFFFFFFFF >> 8), dtype=np.uint32)
    order = np.argsort(-size, kind="stable")  # the longest first: those that have another byte are a prefix
    ranked, begun = size[order], start[order]
    far = int(np.searchsorted(-ranked, -LONG_WORD, side="left"))
    a, b = one[order], two[order]
    for k in range(LONG_WORD if len(ranked) else 0):
        n = int(np.searchsorted(-ranked, -k, side="left"))  # words longer than k
        if n <= far:
            break
        c = data[begun[far:n] + k]
        a[far:n] = crc[(a[far:n] ^ c) & 255] ^ (a[far:n] >> 8)
        b[far:n] = crc[(b[far:n] ^ c) & 255] ^ (b[far:n] >> 8)
    for i in range(far):
        w = data[begun[i] : begun[i] + ranked[i]].tobytes()
        a[i], b[i] = zlib.crc32(w) ^ 0xFFFFFFFF, zlib.crc32(b" " + w) ^ 0xFFFFFFFF
    one[order], two[order] = a, b
    return start, size, one ^ np.uint32(0xFFFFFFFF), two ^ np.uint32(0xFFFFFFFF)


def features(data: np.ndarray, ends: np.ndarray):
    """Yields, by blocks of some megabytes, the document of each word, and (document, bucket) of the runs of each length; documents stand one behind the other in data and end at `ends`.
    A block ends behind a byte that is of no word; the last words before it go on with the next one."""
    lower, word, _ = byte_tables()
    at, held = 0, None
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        if end < len(data):  # back to a word's end
            back = np.flatnonzero(~word[lower[data[at:end]]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # a word longer than a block goes with it, whole
                while end < len(data) and word[lower[data[end]]]:
                    ahead = np.flatnonzero(~word[lower[data[end : end + CHUNK_BYTES]]])
                    end += int(ahead[0]) if len(ahead) else len(data[end : end + CHUNK_BYTES])
        start, size, one, two = words_of(data[at:end])
        doc = np.searchsorted(start + at, ends, side="left")
        doc = np.repeat(np.arange(len(ends)), np.diff(doc, prepend=0))  # documents stand apart by a byte that is of no word
        new = len(doc)
        if held is not None:
            doc, size, one, two = (np.concatenate([x, y]) for x, y in zip(held, (doc, size, one, two), strict=True))
        first = len(doc) - new
        run, runs = one, [(doc[first:], one[first:] % np.uint32(BUCKETS))]
        for n in range(1, RUN):
            run = combined(run[:-1], two[n:], size[n:] + 1)
            own = (doc[n:] == doc[: len(doc) - n]) & (np.arange(n, max(n, len(doc))) >= first)
            runs.append((doc[n:][own], run[own] % np.uint32(BUCKETS)))
        yield doc[first:], runs
        held = tuple(x[-(RUN - 1) :] for x in (doc, size, one, two))
        at = end


def packed(doc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bytes of one bucket's postings in a chunk, in the order of documents: the step from the last document and the count, four bits each. A larger step is made of steps with no count, a
    larger count of counts with no step."""
    gap, rest = np.diff(doc, prepend=-1), count
    skips, adds = (gap - 1) // 15, (rest - 1) // 15
    out = np.repeat(((gap - 15 * skips) << 4) | (rest - 15 * adds), 1 + skips + adds)
    first = np.cumsum(1 + skips + adds) - (1 + skips + adds)
    inside = np.arange(len(out)) - np.repeat(first, 1 + skips + adds)
    skip = np.repeat(skips, 1 + skips + adds)
    out[inside < skip] = 15 << 4
    out[inside > skip] = 15
    return out.astype(np.uint8)


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, counts) of packed bytes; a document may come more than once."""
    return np.cumsum(data >> 4, dtype=np.int64) - 1, (data & 15).astype(np.int64)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each comes."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def chunk_postings(texts: list[bytes]):
    """(words, features) of each text, and (buckets, totals, first byte of each bucket's postings, bytes) of all."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    n = len(texts)
    n_words, n_features, found = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    for words, runs in features(data, ends):
        n_words += np.bincount(words, minlength=n)
        keys = []
        for doc, bucket in runs:
            n_features += np.bincount(doc, minlength=n)
            keys.append((bucket * np.uint32(n) + doc.astype(np.uint32)).astype(np.uint32))  # 10,000 times 1,024 at most
        found.append(counted(np.concatenate(keys)))
    if len(found) == 1:
        key, count = found[0]
    else:
        key, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([c for _, c in found])).astype(np.int64)
    key = key.astype(np.int64)
    bucket, doc = key // n, key % n
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    buckets = bucket[first]
    totals = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
    # one call for all buckets: each begins with a step from before its first document
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first] + 1
    whole = packed(np.cumsum(gap) - 1, count)
    sizes = 1 + (gap - 1) // 15 + (count - 1) // 15
    begin = np.concatenate([[0], np.cumsum(sizes)])[first] if len(first) else np.zeros(0, np.int64)
    return n_words, n_features, buckets, totals, begin, whole


def postings(docs: DataFrame, scratch: Scratch, name: str, *, id_col: str, text_col: str) -> DataFrame:
    """One row for each (chunk, bucket) with bucket, total and packed postings, and one for each document with doc (its number in the chunk), id, n_words and n_features. Written once, so
    that chunks and numbers hold however often a task runs; a chunk is named by the task that wrote it."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("total", pa.int64()), ("postings", pa.binary()), ("doc", pa.int32()), ("n_words", pa.int64()), ("n_features", pa.int64())])

        def rows(ids, texts):
            nonlocal chunk
            n_words, n_features, buckets, totals, begin, whole = chunk_postings(texts)
            n, m, offsets = len(buckets), len(texts), np.append(begin, len(whole)).astype(np.int32)
            lists = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(whole.tobytes())])
            cols = [pa.array(np.full(n, chunk)), pa.array(buckets.astype(np.int32)), pa.array(totals), lists, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, ids.type)], names=[*schema.names, "id"])
            cols = [pa.array(np.full(m, chunk)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(np.arange(m, dtype=np.int32)), pa.array(n_words), pa.array(n_features)]
            yield pa.RecordBatch.from_arrays([*cols, ids], names=[*schema.names, "id"])
            chunk += 1

        for batch in batches:
            start, size, sizes = 0, 0, batch.column(2).to_pylist()
            for i, n in enumerate(sizes):
                if i > start and (size + n > CHUNK_BYTES or i - start >= CHUNK_ROWS):
                    yield from rows(batch.column(0).slice(start, i - start), [x.as_py() for x in batch.column(1).slice(start, i - start)])
                    start, size = i, 0
                size += n
            if start < len(sizes):
                yield from rows(batch.column(0).slice(start), [x.as_py() for x in batch.column(1).slice(start)])

    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.encode(text, "UTF-8").alias("text"), F.octet_length(text).alias("size"))
    return scratch.write(own.mapInArrow(run, f"chunk long, bucket int, total long, postings binary, doc int, n_words long, n_features long, id {kind}"), name)


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of each bucket that docs has: what the corpora have of it, counted in each task and met by bucket."""
    count = lambda p, name: p.where("bucket is not null").groupBy("bucket").agg(F.sum("total").alias(name))
    both = count(docs, "s").join(count(target, "t"), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))  # one row
    ratio = ((F.col("t") + 1) * (F.col("all_s") + BUCKETS)).cast("double") / ((F.col("s") + 1) * (F.col("all_t") + BUCKETS)).cast("double")
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, target: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight): one row for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = postings(docs, scratch, "postings", id_col=id_col, text_col=text_col)
    other = postings(target.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), scratch, "target", id_col="id", text_col="text")
    gain = scratch.write(gains(own, other), "gains")

    # by bucket, where the gain is; then by chunk, so that a task has one chunk's sums at a time
    met = own.where("bucket is not null").select("bucket", "chunk", "postings").join(gain.hint("shuffle_hash"), "bucket").select("chunk", "gain", "postings").sortWithinPartitions("chunk")

    def contribute(batches):
        import pyarrow as pa

        open_, sums = None, np.zeros(CHUNK_ROWS, np.int64)

        def done():
            doc = np.flatnonzero(sums)
            return open_, doc.astype(np.int32), sums[doc]

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["chunk", "docs", "sums"])

        for batch in batches:
            out = []
            for chunk, g, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if chunk != open_:
                    if open_ is not None:
                        out.append(done())
                    open_ = chunk
                    sums[:] = 0
                doc, count = unpacked(np.frombuffer(data.as_buffer(), np.uint8))
                at = np.bincount(doc[count > 0], weights=count[count > 0])  # counts are whole numbers far below 2^53
                sums[: len(at)] += at.astype(np.int64) * g
            yield rows(out)
        if open_ is not None:
            yield rows([done()])

    contributions = met.mapInArrow(contribute, "chunk long, docs array<int>, sums array<long>")

    def reduce(key, docs_, sums_):
        import pyarrow as pa

        docs_ = docs_.sort_by("doc")
        out = np.zeros(len(docs_), np.int64)
        for docs, sums in zip(sums_.column("docs"), sums_.column("sums"), strict=True):
            out[docs.values.to_numpy()] += sums.values.to_numpy()
        return pa.table([docs_.column("id"), docs_.column("n_words"), docs_.column("n_features"), pa.array(out)], names=["id", "n_words", "n_features", "weight"])

    # a chunk has CHUNK_ROWS documents at most, and no more contributions than its few megabytes of text have runs of words
    every = own.where("doc is not null").select("chunk", "doc", "id", "n_words", "n_features")
    return every.groupBy("chunk").cogroup(contributions.groupBy("chunk")).applyInArrow(reduce, f"id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, min_words: int = 20, seed: str = "42", id_col: str = "doc_id", text_col: str = "text", rows_a_range: int = 50_000) -> DataFrame:
    """One row for each row of docs: id, n_words, n_features, weight, score, rank (long; rank null where it isn't drawn).

    Of the rows with at least min_words words, floor(percent * n / 100) with the highest scores are drawn, ties by the smaller id (null last). Null and empty texts, in docs or target, have no
    words and weight 0. Rows that share an id, or have none, are rows by themselves; of such rows with one score too, which comes first is open. Ids of any type that has an order; other
    columns are ignored; an empty table gives no rows, and an empty target is a corpus of nothing."""
    scratch = Scratch(docs.sparkSession, "importance")
    found = weights(docs, target, scratch, id_col=id_col, text_col=text_col)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = scratch.write(found.withColumn("score", F.col("weight") + noise), "scored")
    can = F.col("n_words") >= min_words
    n = scored.where(can).count()
    drawn = percent * n // 100
    # ranges of scores from the highest on; their number follows the rows, and a thousand bounds are the most that the plan holds
    parts = max(1, min(1000, -(-n // rows_a_range)))
    bounds = scored.where(can).select(F.percentile_approx("score", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    own = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds or [])))), lambda b: b >= F.col("score"))) if bounds else F.lit(0)
    ranged = scored.withColumn("range", F.when(can, own))
    sizes = {r["range"]: r["n"] for r in ranged.where("range is not null").groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, so_far = {}, 0
    for r in sorted(sizes):
        first[r] = so_far
        so_far += sizes[r]
    chosen = [r for r in first if first[r] < drawn]
    begin = F.element_at(F.create_map(*[F.lit(x) for r in chosen for x in (r, first[r])]), F.col("range")) if chosen else F.lit(0)
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())) + begin
    ranked = ranged.where(F.col("range").isin(chosen)).withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = ranged.where(~F.coalesce(F.col("range").isin(chosen), F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def op11_importance(spark, sf_dir):
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")

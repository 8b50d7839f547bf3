"""BPE by a minimal acyclic transducer.

The corpus' frequent words are compiled into one automaton that shares prefixes and suffixes and whose transitions carry how many words lie
before them, so that a walk over a word adds up to the word's number and thereby to its ids. The automaton is a few flat arrays in one file in the shared folder;
every worker maps it into memory. Words that the automaton does not know are merged exactly, all unseen words of a batch at once.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shared_dir, table
from .tokencount import PATTERN, WHITE, byte_letters

NONE = np.int32(2**31 - 1)


def gather(offsets: np.ndarray, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a ragged array one after another: (offsets, data)."""
    size = (offsets[1:] - offsets[:-1])[rows]
    out = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    at = np.repeat(offsets[:-1][rows] - out[:-1], size) + np.arange(out[-1])
    return out, data[at]


class Vocabulary:
    """A byte-level BPE vocabulary file: bytes of each id, merges by rank, special strings."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for k, v in vocab.items():
            self.bytes_of[v] = bytes(letters[c] for c in k)
        for k, v in self.special.items():
            self.bytes_of[v] = k.encode()
        self.first = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._hash(np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.uint64))
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        # a chunk is white space and what follows up to the next white space: no word spans two chunks
        self.chunks = regex.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self._blank_before_space = regex.compile(f"[{WHITE}] ").search

    def spaced(self, text: str) -> bool:
        """Whether each space comes after something that isn't white space: then text.split(" ") makes chunks, each but the first less its space."""
        if text.isascii():
            return not any(x in text for x in ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")) and text[:1] != " "
        return not self._blank_before_space(text) and text[:1] != " "

    def _hash(self, keys: np.ndarray, bits: int = 20) -> None:
        """Ranks by pair, in a table of as many ways as the fullest slot needs."""
        self.shift, self.odd = np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15)
        slot = ((keys * self.odd) >> self.shift).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        s = slot[order]
        way = np.arange(len(s)) - np.searchsorted(s, s)
        self.ways = [(np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, NONE, np.int32)) for _ in range(int(way.max(initial=0)) + 1)]
        for (k, r), w in zip(self.ways, range(len(self.ways)), strict=True):
            mine = order[way == w]
            k[slot[mine]] = keys[mine]
            r[slot[mine]] = mine

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = ((key * self.odd) >> self.shift).astype(np.int64)
        out = np.full(len(key), NONE, np.int32)
        for k, r in self.ways:
            hit = k[slot] == key
            out[hit] = r[slot[hit]]
        return out

    def symbols(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids that the words' bytes begin with."""
        return self.first[data]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of many words at once: (offsets, ids). In each round every word does its merge of lowest rank, from left to
        right where it occurs more than once, until no word has any."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbols(np.frombuffer(b"".join(words), np.uint8), sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        while len(sym):
            new = np.empty(len(sym), bool)
            new[0] = True
            np.not_equal(word[1:], word[:-1], out=new[1:])
            starts = np.flatnonzero(new)
            rank = np.full(len(sym), NONE, np.int32)
            inner = np.flatnonzero(~new[1:])
            rank[inner] = self.rank(sym[inner], sym[inner + 1])
            low = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(sym)))
            each = np.repeat(low, counts)
            over = each == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            hit = np.flatnonzero((rank == each) & ~over)
            if len(hit) > 1:  # of pairs that overlap, as in aaa, every second one waits
                run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
                place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
                hit = hit[place % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = ~over
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int32)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        offsets = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(word, minlength=len(words)), out=offsets[1:])
        return offsets, sym[order]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# The file: eight int64 lengths, then the arrays one after another, each from a multiple of eight bytes on.
PARTS = (("bits", np.uint64), ("before", np.uint8), ("first", np.int64), ("target", np.int32), ("skip", np.int32), ("final", np.uint8), ("offsets", np.int64), ("ids", np.int32))


def compile_lexicon(words: list[bytes], vocab: Vocabulary) -> bytes:
    """The minimal automaton of the words (distinct, not empty), with each word's ids as output, as the bytes of a file.

    Words are added in order; a state that gets no more transitions is replaced by an equal one that exists, so that
    common ends are shared. A transition's skip is the number of words that come before those behind it."""
    words = sorted(words)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []
    path: list[list] = [[False, []]]  # of the last word: [is a word's end, transitions], the last transition still open
    last = b""

    def close(down_to: int) -> None:
        while len(path) > down_to + 1:
            end, out = path.pop()
            key = (end, tuple(out))
            if key not in register:
                register[key] = len(states)
                states.append((end, out))
            path[-1][1][-1] = (path[-1][1][-1][0], register[key])

    for w in words:
        common = len(os.path.commonprefix([w, last]))
        close(common)
        for b in w[common:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = w
    close(0)
    states.append(tuple(path[0]))
    n = len(states)
    below = np.zeros(n, np.int64)  # words from a state on; a state's targets come before it
    bits, before, first, target, skip = np.zeros((n, 4), np.uint64), np.zeros((n, 4), np.uint8), np.zeros(n + 1, np.int64), [], []
    for s, (end, out) in enumerate(states):
        first[s] = len(target)
        seen = int(end)
        masks = [0, 0, 0, 0]
        for b, t in out:
            masks[b >> 6] |= 1 << (b & 63)
            target.append(t)
            skip.append(seen)
            seen += below[t]
        bits[s] = masks
        before[s] = np.cumsum([0] + [m.bit_count() for m in masks[:3]])
        below[s] = seen
    first[n] = len(target)
    offsets, ids = vocab.merge(words)
    parts = [bits.ravel(), before.ravel(), first, np.array(target, np.int32), np.array(skip, np.int32), np.array([e for e, _ in states], np.uint8), offsets, ids]
    out = [np.array([len(p) for p in parts], np.int64).tobytes()]
    for p, (_, kind) in zip(parts, PARTS, strict=True):
        raw = p.astype(kind).tobytes()
        out.append(raw + b"\0" * (-len(raw) % 8))
    return b"".join(out)


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        sizes, at = raw[: 8 * len(PARTS)].view(np.int64), 8 * len(PARTS)
        for (name, kind), n in zip(PARTS, sizes, strict=True):
            size = int(n) * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + size].view(kind))
            at += size + (-size % 8)
        self.bits, self.before = self.bits.reshape(-1, 4), self.before.reshape(-1, 4)
        self.root = len(self.final) - 1

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1. All words walk at once, a byte a step."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.target):
            return out
        flat = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        at = np.concatenate(([0], end[:-1]))
        who, state, number = np.arange(len(words)), np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        while len(who):
            over = at == end
            if over.any():
                found = over & (self.final[state] == 1)
                out[who[found]] = number[found]
                going = ~over
                who, state, number, at, end = who[going], state[going], number[going], at[going], end[going]
                if not len(who):
                    break
            byte = flat[at]
            quarter, place = byte >> 6, (byte & 63).astype(np.uint64)
            mask = self.bits[state, quarter]
            has = (mask >> place) & np.uint64(1) == 1
            who, state, number, at, end, mask, place, quarter = (x[has] for x in (who, state, number, at, end, mask, place, quarter))
            edge = self.first[state] + self.before[state, quarter] + np.bitwise_count(mask & ((np.uint64(1) << place) - np.uint64(1)))
            number, state, at = number + self.skip[edge], self.target[edge].astype(np.int64), at + 1
        return out


@lru_cache(maxsize=4)
def mapped(path: str) -> Lexicon:
    return Lexicon(path)


def encode_texts(texts: list[str], vocab: Vocabulary, lexicon: Lexicon | None) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of the texts. Equal chunks and equal words of the texts are looked up once."""
    chunk_no: dict[str, int] = {}  # keys: chunks less a leading space, or with a leading NUL and all of them
    number = chunk_no.setdefault
    rows, sizes = [], []
    for text in texts:
        n = len(rows)
        if vocab.cut and any(s in text for s in vocab.special):
            for i, part in enumerate(vocab.cut(text)):
                # a special string is a chunk of its own
                rows += [number("\0s" + part, len(chunk_no))] if i % 2 else [number("\0c" + c, len(chunk_no)) for c in vocab.chunks(part)]
        elif "\0" not in text and vocab.spaced(text):
            pieces = text.split(" ")
            rows.append(number("\0c" + pieces[0], len(chunk_no)))
            rows += [number(c, len(chunk_no)) for c in pieces[1:]]
        else:
            rows += [number("\0c" + c, len(chunk_no)) for c in vocab.chunks(text)]
        sizes.append(len(rows) - n)
    specials = {"\0s" + s: i for s, i in vocab.special.items()}
    word_no: dict[str, int] = {}
    number = word_no.setdefault
    in_chunk, counts, fixed = [], [], {}
    for i, c in enumerate(chunk_no):
        if c in specials:
            fixed[i] = specials[c]
            counts.append(0)
            continue
        w = [number(x, len(word_no)) for x in vocab.split(c[2:] if c[:2] == "\0c" else " " + c)]
        in_chunk += w
        counts.append(len(w))
    words = [w.encode() for w in word_no]
    found = lexicon.find(words) if lexicon is not None else np.full(len(words), -1, np.int64)
    known, unseen = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
    new_off, new_ids = vocab.merge([words[i] for i in unseen])
    size = np.zeros(len(words), np.int64)
    size[unseen] = np.diff(new_off)
    if len(known):
        old_off, old_ids = gather(lexicon.offsets, lexicon.ids, found[known])
        size[known] = np.diff(old_off)
        both_off = np.concatenate((new_off, new_off[-1] + old_off[1:]))
        both_ids = np.concatenate((new_ids, old_ids))
    else:
        both_off, both_ids = new_off, new_ids
    place = np.empty(len(words), np.int64)
    place[unseen], place[known] = np.arange(len(unseen)), len(unseen) + np.arange(len(known))
    # words -> chunks -> texts
    word_rows = place[np.array(in_chunk, np.int64)] if in_chunk else np.zeros(0, np.int64)
    off, ids = gather(both_off, both_ids, word_rows)
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    chunk_off = off[bounds]
    if fixed:
        lengths = np.diff(chunk_off)
        for i in fixed:
            lengths[i] = 1
        where = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=where[1:])
        ids_all = np.empty(where[-1], np.int32)
        mask = np.ones(where[-1], bool)
        for i, v in fixed.items():
            ids_all[where[i]], mask[where[i]] = v, False
        ids_all[mask] = ids
        chunk_off, ids = where, ids_all
    out_off, out_ids = gather(chunk_off, ids, np.array(rows, np.int64))
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return out_off[ends], out_ids.astype(np.int32, copy=False)


def byte_batches(texts: list[str], most: int = 12 << 20):
    """(start, end) of runs of texts with about `most` characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _here(path: str) -> str:
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))


def frequent_words(docs: DataFrame, path: str, top: int, text_col: str = "text", most_bytes: int = 64, hold: int = 400_000) -> list[bytes]:
    """The `top` most frequent words of the vocabulary's kind. What stands between spaces is counted over every text (each task adds up
    what it has seen before it sends); the most frequent of it, 2 * top at most, are taken apart into words."""

    def run(batches):
        import pyarrow as pa

        seen: Counter = Counter()

        def sent():
            keep = [(w, n) for w, n in seen.items() if w and len(w) <= most_bytes]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in keep], pa.string()), pa.array([n for _, n in keep], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(text.as_py().split(" "))
                if len(seen) >= hold:
                    yield sent()
        if seen:
            yield sent()

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    counts = docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = Scratch(docs.sparkSession, "words").write(counts.where("n > 1").withColumn("rank", F.floor(F.log2("n") * 16).cast("int")), "counts")
    # the count from which on there are at most 2 * top words, from a histogram of a thousand bins at most
    room, least = 2 * top, None
    for rank, k in sorted(map(tuple, counts.groupBy("rank").count().collect()), reverse=True):
        room -= k
        if room < 0:
            break
        least = rank
    vocab, words = vocabulary(_here(path)), Counter()
    frequent = counts.where(F.col("rank") >= (2**30 if least is None else least)).select("word", "n")
    for word, n in frequent.collect():  # bounded by top
        for w in vocab.split(" " + word):
            words[w.encode()] += n
    return [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:top]]


def ship_lexicon(docs: DataFrame, path: str, top: int = 1 << 16, text_col: str = "text") -> str:
    """Compiles the lexicon of docs into the shared folder and has it brought to each executor; returns its name."""
    spark = docs.sparkSession
    raw = compile_lexicon(frequent_words(docs, path, top, text_col), vocabulary(_here(path)))
    name = f"lexicon-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = where.getFileSystem(conf).create(where)
    out.write(bytearray(raw))
    out.close()
    spark.sparkContext.addFile(f"{shared_dir(spark)}/{name}")
    return name


def map_ids(docs: DataFrame, path: str, schema: str, made, *, keep: str, text_col: str = "text", top: int = 1 << 16) -> DataFrame:
    """mapInArrow over (keep, text); made(vocab, offsets, ids) gives the columns of schema after the first."""
    name = ship_lexicon(docs, path, top, text_col)

    def run(batches):
        import pyarrow as pa
        from pyspark import SparkFiles

        vocab, lexicon = vocabulary(_here(path)), mapped(SparkFiles.get(name))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in byte_batches(texts):
                off, ids = encode_texts(texts[a:b], vocab, lexicon)
                columns = made(vocab, off, ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns.values()], names=["id", *columns])

    kind = docs.schema[keep].dataType.simpleString()
    out = docs.select(F.col(keep).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, {schema}")
    return out.withColumnRenamed("id", keep)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", top: int = 1 << 16) -> DataFrame:
    """(id, ids array<int>): each whole text's ids. Null text counts as empty and has none. Null ids and repeated rows are rows like
    others; other columns are ignored; an empty table gives no rows. `top` bounds the lexicon, and so what is collected and shipped."""

    def made(vocab, off, ids):
        import pyarrow as pa

        return {"ids": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))}

    return map_ids(docs, path, "ids array<int>", made, keep=id_col, text_col=text_col, top=top)


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each row's ids; bytes that aren't UTF-8 become U+FFFD. Null ids: empty text."""

    def run(batches):
        import pyarrow as pa

        vocab = vocabulary(_here(path))
        for batch in batches:
            texts = [b"".join([vocab.bytes_of[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", top: int = 1 << 16) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes each whole text, and gives digests of both in place of the
    arrays, which need not leave the worker."""

    def made(vocab, off, ids):
        import pyarrow as pa

        names, table_of, flat, bounds = decimals(len(vocab.bytes_of)), vocab.bytes_of, ids.tolist(), off.tolist()
        a, b = [], []
        for s, e in itertools.pairwise(bounds):
            own = flat[s:e]
            a.append(hashlib.sha256(b",".join([names[i] for i in own])).hexdigest())
            b.append(hashlib.sha256(b"".join([table_of[i] for i in own]).decode("utf-8", "replace").encode()).hexdigest())
        return {"n_tokens": pa.array(np.diff(off), pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}

    return map_ids(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", made, keep=id_col, text_col=text_col, top=top)


@lru_cache(maxsize=1)
def decimals(n: int) -> list[bytes]:
    return [str(i).encode() for i in range(n)]


def op4_bpe(spark, sf_dir):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

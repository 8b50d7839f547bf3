"""Packing of documents into sequences: concatenate and cut.

All documents' ids make one stream, in the order of the tables' tasks and of the rows in them. A first pass tokenizes each document once, keeps its ids and, inside its task, the number of
ids before it; the tasks' totals, added up, give each task its place in the stream. A second pass cuts the stream at fixed windows. A window that lies in one task is a whole sequence; what
a task has of the windows at its two ends are boundary records, which meet by the window's number.
"""

from __future__ import annotations

import gc
import json
import os
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import Scratch, table
from .tokencount import byte_letters

#: The longest text between white space that is remembered, how many of them a task remembers, and the characters of texts that it takes at once.
REMEMBERED, WORDS, STRETCH = 64, 1 << 19, 1 << 21
#: ASCII signs that are of no contraction: behind letters they are a piece.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
END_ID = 1


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    lib.no_padding()
    lib.no_truncation()
    return lib


class WordVocabulary(bpe.Vocabulary):
    """A vocabulary whose words end in an id of their own kind."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, ending = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = [c for c, _ in sorted(byte_letters().items(), key=lambda x: x[1])]
        self.first, self.last = (np.array([vocab[c + e] for c in letters], np.int32) for e in ("", ending))
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._hash(np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.uint64))

    def symbols(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out, ends = self.first[data], np.cumsum(sizes) - 1
        out[ends] = self.last[data[ends]]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordVocabulary:
    return WordVocabulary(path)


class WordIds:
    """Ids of texts as little-endian bytes. The vocabularies drop white space and no token spans it, so that what stands between spaces, line feeds and tabs is encoded by itself and remembered
    if it is short. Words of Latin letters, with or without signs behind them, are one or two pieces whose merges are done many at once; all others go to the library. The memory is
    emptied when it is full, so that it is bounded."""

    def __init__(self, path: str):
        self.lib, self.vocab = library(path), vocabulary(path)
        self.kind = np.dtype("<u2" if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {"": b""}

    def learn(self, words: set[str]) -> None:
        """Puts the ids of words to what is known."""
        known, own, heads, tails, other = self.known, [], [], [], []
        for w in words:
            letters = w.rstrip(SIGNS)
            if not letters or (letters.isalpha() and (letters.isascii() or max(letters) < "\u0100")):
                own.append(w)
                heads.append(letters.lower())
                tails.append(w[len(letters) :])
            else:
                other.append(w)
        new = list({*heads, *tails}.difference(known))
        offsets, ids = self.vocab.merge([p.encode() for p in new])
        data, bounds = ids.astype(self.kind).tobytes(), (offsets * self.kind.itemsize).tolist()
        known.update(zip(new, map(data.__getitem__, map(slice, bounds, bounds[1:])), strict=True))
        get = known.__getitem__
        known.update(zip(own, map(bytes.__add__, map(get, heads), map(get, tails)), strict=True))
        if other:
            found = self.lib.encode_batch_fast(other, add_special_tokens=False)
            known.update((w, np.array(e.ids, dtype=self.kind).tobytes()) for w, e in zip(other, found, strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of some megabytes of texts; what they need stays known until all have theirs."""
        if len(self.known) > WORDS:
            self.known = {"": b""}
        get, lists, unseen = self.known.get, [], set()
        for text in texts:
            words = text.replace("\n", " ").replace("\t", " ").split(" ")
            found = list(map(get, words))
            if None in found:
                unseen.update(w for w in words if w not in self.known)
                found = None
            lists.append((words, found))
        if unseen:
            self.learn(unseen)
        out = [b"".join(map(get, words) if found is None else found) for words, found in lists]
        for w in unseen:
            if len(w) > REMEMBERED:
                self.known.pop(w, None)
        return out

    def long(self, text: str) -> bytes:
        """The ids of a text of any length, read in stretches that end at a space."""
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + STRETCH)
            end = len(text) if end < 0 else end
            out += self([text[at:end]])
            at = end
        return b"".join(out)


def drops_white_space(path: str) -> bool:
    """The vocabulary's file splits at white space and drops it, so that texts may be encoded word by word."""
    spec = json.load(open(path, encoding="utf-8"))
    pre = spec.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    normal = spec.get("normalizer") or {}
    simple = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " ") for x in normal.get("normalizers", [normal] if normal else []))
    split = parts[0]
    removes = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and split["pattern"].get("Regex", "").endswith("[^\\s\\p{L}\\p{N}]+")
    whole = all(x["type"] == "ByteLevel" and not x["use_regex"] and not x["add_prefix_space"] for x in parts[1:])
    ending = spec["model"].get("end_of_word_suffix") and not spec["model"].get("continuing_subword_prefix") and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")
    return bool(simple and removes and whole and ending and not spec.get("post_processor") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]))


def tokenized(docs: DataFrame, path: str, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, before, n, id, ids): each row's ids with END_ID behind them, as bytes; part is the task that made it and before the ids that this task has before it. Written once, so that
    places hold however often a task runs."""
    name = os.path.basename(path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import public_tokenizers
        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's own core is all it has
        here = path if os.path.exists(path) else public_tokenizers.path(name)
        if not drops_white_space(here):
            raise ValueError(f"{name} keeps white space: its texts can't be encoded word by word")
        ids_of, part, before = WordIds(here), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], dtype=ids_of.kind).tobytes()
        gc.disable()  # strings and numbers alone are kept, and many: looking through them for cycles is half of the time

        def rows(some, texts):
            nonlocal before
            ids = [x + end for x in ([ids_of.long(texts[0])] if len(texts) == 1 else ids_of(texts))]
            n = np.array([len(x) // ids_of.kind.itemsize for x in ids], dtype=np.int64)
            places = before + np.concatenate([[0], np.cumsum(n)])
            before = int(places[-1])
            return pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(places[:-1]), pa.array(n), some, pa.array(ids, pa.binary())], names=["part", "before", "n", "id", "ids"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in bpe.byte_batches(texts, STRETCH):
                yield rows(batch.column(0).slice(start, stop - start), texts[start:stop])

    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return scratch.write(own.mapInArrow(run, f"part int, before long, n long, id {kind}, ids binary"), "tokens")


def placed(tokens: DataFrame) -> DataFrame:
    """tokens with `at`, the place of a row's first id in the whole stream. What is joined is one row of two numbers for each task that wrote tokens, thousands of times fewer than its
    rows and some megabytes for a million tasks, so that it is broadcast; the ids stay where they are."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tokens.join(F.broadcast(totals.select("part", before.alias("offset"))), "part").withColumn("at", F.col("offset") + F.col("before")).drop("offset", "before")


def _width(path: str) -> int:
    import public_tokenizers

    return WordIds(path if os.path.exists(path) else public_tokenizers.path(os.path.basename(path))).kind.itemsize


def pack(docs: DataFrame, path: str, *, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (long but for the id).

    A document's ids are the tokenizer's for its whole text, and END_ID; null text counts as empty, so that each row has a piece. Every sequence but the last is full: nothing is padded but
    that one. Rows that share an id, or have none, are documents by themselves; other columns are ignored; an empty table gives no rows. Only two numbers a task are shuffled."""
    tokens = placed(tokenized(docs, path, Scratch(docs.sparkSession, "packing"), id_col=id_col, text_col=text_col))
    kind, width = docs.schema[id_col].dataType.simpleString(), _width(path)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            owner = []
            for i, (at, n, ids) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True)):
                ids = np.frombuffer(ids.as_buffer(), dtype=f"<u{width}").astype("<u4")
                for begin, end in cuts(at, n, size):
                    owner.append(i)
                    for column, v in zip(rows, (begin, end - begin, zlib.crc32(ids[begin:end]), n, (at + begin) // size, (at + begin) % size), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in rows)], names=["id", *names])

    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = tokens.select("at", "n", "id", "ids").mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in names))
    return out.withColumnRenamed("id", id_col)


def cuts(at: int, n: int, size: int) -> list[tuple[int, int]]:
    """Where a document of n ids, the first of which is the stream's number `at`, falls apart at the windows."""
    places = [0, *range(size - at % size, n, size), n]
    return list(zip(places, places[1:], strict=False))


def sequences(docs: DataFrame, path: str, *, size: int = 2048, text_col: str = "text", id_col: str = "doc_id", pad_id: int = 0) -> DataFrame:
    """(sequence_id long, n long, ids array<int>): the sequences themselves, each once, all of `size` ids but the last, which is padded with pad_id to a power of two at most; n counts the
    ids that aren't padding. A task puts the whole windows of each stretch that it reads together by itself; only
    the two at a stretch's ends, of less than `size` ids each, are shuffled."""
    tokens = placed(tokenized(docs, path, Scratch(docs.sparkSession, "sequences"), id_col=id_col, text_col=text_col))
    # a task of the second pass reads stretches of the first pass's files, each in order; where one ends, so does its last piece
    tokens = tokens.select("at", "n", "ids")
    width = _width(path)

    def run(batches):
        held: list = []  # pieces of the open window, one after the other
        window, begun, filled = None, 0, 0

        def closed():
            ids = np.concatenate(held).astype(np.int32)
            return window, begun, begun == 0 and len(ids) == size, ids

        for batch in batches:
            out = []
            for at, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(ids.as_buffer(), dtype=f"<u{width}")
                for begin, end in cuts(at, n, size):
                    place = (at + begin) // size
                    if place != window or (at + begin) % size != begun + filled:
                        if held:
                            out.append(closed())
                        held, window, begun, filled = [], place, (at + begin) % size, 0
                    held.append(ids[begin:end].copy())
                    filled += end - begin
            yield _pieces(out)
        if held:
            yield _pieces([closed()])

    def _pieces(out):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.bool_()), pa.array([x[3] for x in out], pa.list_(pa.int32()))], names=["sequence_id", "begin", "whole", "ids"]
        )

    # written, so that the windows are cut once and not for whole ones and boundary records each
    found = Scratch(docs.sparkSession, "windows").write(tokens.mapInArrow(run, "sequence_id long, begin int, whole boolean, ids array<int>"), "windows")
    met = found.where("not whole").groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("begin", "ids"))), lambda x: x["ids"])).alias("ids"))
    every = found.where("whole").select("sequence_id", "ids").unionByName(met)
    full = F.expr(f"least({size}, cast(pow(2, ceil(log2(size(ids)))) as int))")
    return every.select("sequence_id", F.size("ids").cast("long").alias("n"), F.concat("ids", F.array_repeat(F.lit(pad_id), full - F.size("ids"))).alias("ids"))


def op13_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

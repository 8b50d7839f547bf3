"""Token counts: lengths only, by Arrow batches that are balanced by bytes."""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: The pre-tokenizer of byte-level vocabularies, and white space as that pattern takes it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def safe_pieces(text: str, most: int, boundary=re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")):
    """Cuts a long text where white space follows something else: no token of a byte-level vocabulary spans such a place, so
    that the pieces' counts add up. A stretch without such a place stays whole."""
    start = 0
    while len(text) - start > most:
        cut = boundary.search(text, start + most)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@lru_cache(maxsize=4)
def counter(path: str):
    """(function from a list of texts to their token counts, whether pieces of a text add up)."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    spec = json.load(open(path, encoding="utf-8"))
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    letters = byte_letters()
    plain = model["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    if plain:
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in model["vocab"].items() if k not in special}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        made = [vocab.get(a + b) for a, b in pairs]
        # a merge's place in the list must be its id's place, for ranks to stand for the list
        plain = made == sorted(x for x in made if x is not None) and all(t["special"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
    if plain:
        import tiktoken

        ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items()}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        allowed = set(special)
        return lambda texts: [len(enc.encode(x, allowed_special=allowed, disallowed_special=())) for x in texts], True
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    lib.no_padding()
    lib.no_truncation()
    return lambda texts: [len(x.ids) for x in lib.encode_batch_fast(texts, add_special_tokens=False)], False


def counts_of(texts: list[str], path: str, batch_bytes: int = 1 << 20, piece_chars: int = 1 << 16) -> list[int]:
    """Token counts of whole texts. Long texts go in pieces; pieces are gathered to batches of about batch_bytes."""
    count, additive = counter(path)
    out, batch, owner, size = [0] * len(texts), [], [], 0

    def flush():
        nonlocal size
        for i, n in zip(owner, count(batch), strict=True):
            out[i] += n
        batch.clear(), owner.clear()
        size = 0

    for i, text in enumerate(texts):
        for piece in safe_pieces(text, piece_chars) if additive else (text,):
            batch.append(piece)
            owner.append(i)
            size += len(piece)
            if size >= batch_bytes:
                flush()
    flush()
    return out


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row a row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty: 0 tokens. Null ids, repeated rows and extra columns are fine; only id and text go to Python, and
    only lengths come back. An empty table gives no rows. There is no shuffle."""
    import os

    name = os.path.basename(path)

    def run(batches):
        import pyarrow as pa
        import public_tokenizers

        here = path if os.path.exists(path) else public_tokenizers.path(name)
        for batch in batches:
            n = counts_of(batch.column(2).to_pylist(), here)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

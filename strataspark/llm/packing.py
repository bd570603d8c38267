"""Sum-of-squares packing of tokenized documents into fixed-length sequences.

A document is its token ids and one end id; longer ones are cut into pieces of
SEQUENCE_TOKENS, the first piece taking the remainder. Pieces are dealt evenly
to groups of about GROUP_PIECES; each group packs its pieces, longest first:
of the residual gaps that open sequences have and that hold the piece, it goes
to the one that makes the sum of squared counts of open sequences per gap
smallest (ties: smallest gap), and opens a sequence only where none fits.

Defined results: a null text is an empty one and has the end id alone; rows of
one id, repeated rows too, are pieces of their own; an empty table packs into
nothing. Other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import materialize, text_batches

SEQUENCE_TOKENS = 1024
END_ID = 2
#: Pieces of a packing group: the memory of one task, some MB, and the waste of
#: one partly filled tail per group follow from it.
GROUP_PIECES = 50_000
#: Above these code points the two tokenizer libraries may know other Unicode tables.
_FAR = re.compile("[ɐ-\U0010ffff]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _exact(path: str, plain: bool = False):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = plain
    return exact


@lru_cache(maxsize=1)
def _specials(path: str) -> tuple[str, ...]:
    """Strings that the tokenizer takes for a special token wherever they stand; read from its
    file, as the tokenizer itself would stay in every worker's memory."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    added, _ = json.JSONDecoder().raw_decode(text, text.index("[", text.index('"added_tokens"')))
    return tuple(t["content"] for t in added)


@lru_cache(maxsize=1)
def _fast(path: str):
    """A faster, equal encoder, where the tokenizer's ranks stand beside it."""
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encode(text: str | None, path: str, plain: bool = False) -> np.ndarray:
    """Token ids of a whole text, as the tokenizer has them by default: a special token's
    string is that token, or ordinary text where ``plain``. The ranks' encoder serves
    texts of Latin letters without such strings."""
    fast = _fast(path)
    text = text or ""
    if fast is not None and not _FAR.search(text) and (plain or not any(s in text for s in _specials(path))):
        return np.array(fast.encode_ordinary(text), dtype="<u4")
    return np.array(_exact(path, plain).encode(text, add_special_tokens=False).ids, dtype="<u4")


@lru_cache(maxsize=1)
def _begins_with_space(path: str) -> np.ndarray:
    fast = _fast(path)
    return np.array([fast.decode_single_token_bytes(i)[:1] == b" " for i in range(fast.n_vocab)])


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word behind a space, one after another, and how many each has.

    Tokens never reach over the space before a word, so all words are encoded as
    one text and parted at the tokens that begin with a space. Strings of special
    tokens are ordinary text.
    """
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    text = " " + " ".join(words)
    if _fast(path) is not None and not _FAR.search(text):
        ids = np.array(_fast(path).encode_ordinary(text), dtype=np.int64)
        starts = np.flatnonzero(_begins_with_space(path)[ids])
        if len(starts) == len(words):
            return ids, np.diff(starts, append=len(ids))
    each = [encode(" " + w, path, plain=True).astype(np.int64) for w in words]
    return np.concatenate(each), np.array([len(e) for e in each], dtype=np.int64)


def cut(n: int, most: int = SEQUENCE_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter."""
    first = n % most or min(n, most)
    return [(0, first), *((at, most) for at in range(first, n, most))] if n else []


def pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    path = tokenizer or default_tokenizer()
    text_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<piece: int, start: long, length: long, ids_crc32: long>>")
    def cut_up(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for text in batch:
                ids = np.append(encode(text, path), np.uint32(END_ID)).astype("<u4")
                out.append(
                    [
                        {"piece": k, "start": start, "length": n, "ids_crc32": zlib.crc32(ids[start : start + n].tobytes())}
                        for k, (start, n) in enumerate(cut(len(ids)))
                    ]
                )
            yield pd.Series(out, dtype=object)

    return docs.select("doc_id", F.explode(cut_up("text")).alias("p")).select("doc_id", "p.*")


def sum_of_squares(lengths: np.ndarray, capacity: int = SEQUENCE_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces are placed longest first."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by gap
    count = np.zeros(capacity + 1, dtype=np.int64)
    made = 0
    for i in order:
        size = int(lengths[i])
        gaps = size + np.flatnonzero(count[size:capacity])
        if len(gaps):
            # from gap g to g - size: the squares change by 2 * (count[g - size] - count[g]) + 2,
            # and by 1 - 2 * count[g] where the bin is filled
            after = gaps - size
            change = 2 * (count[after] - count[gaps]) + 2
            change[after == 0] = 1 - 2 * count[size] if count[size] else 0
            gap = int(gaps[int(change.argmin())])
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            open_bins[gap - size].append(b)
            count[gap - size] += 1
    return bins, offsets


def pack_pieces(cut_pieces: DataFrame) -> DataFrame:
    """Adds sequence_id and offset to materialized pieces."""
    numbered = materialize(cut_pieces.withColumn("__uid", F.monotonically_increasing_id()), "pack-pieces")
    groups = max(1, -(-numbered.count() // GROUP_PIECES))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__uid", ignore_index=True)
        bins, offsets = sum_of_squares(group["length"].to_numpy())
        group["sequence_id"] = group["__group"] * (1 << 32) + bins
        group["offset"] = offsets
        return group[[x.split()[0] for x in placed.split(", ")]]

    placed = "id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    dealt = numbered.withColumn("__group", F.pmod(F.xxhash64("__uid"), F.lit(groups)))
    # ids pass as text: a null among them would turn longs into doubles in pandas
    dealt = dealt.withColumn("id", F.col("doc_id").cast("string")).drop("doc_id")
    packed = dealt.groupBy("__group").applyInPandas(run, placed)
    return packed.select(F.col("id").cast("long").alias("doc_id"), *[x.split()[0] for x in placed.split(", ")[1:]])


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of ``docs`` with its sequence and place there."""
    return pack_pieces(pieces(docs, tokenizer))

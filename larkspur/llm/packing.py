"""Packing by power-of-two decomposition.

A document's token ids are split into pieces whose lengths are powers of two: as many of the largest length as fit, then the
binary digits of the rest. Each piece is a sequence of its own, numbered with others of equal length, so that batches of one
length need no padding and no sequence crosses documents.

Tokens: the ids that `tokenizers` gives for a byte-level BPE file. Only the pieces' digests are shuffled, for dense numbers
within each length, salted into groups of about `group_rows` rows. Groups are counted and summed up in the cluster, in two
levels of windows; the driver sees one row a length.

Cases: null text is the empty text: the closing id alone, one piece. Repeated rows give pieces of their own. An empty table
gives an empty result."""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import cut, ship

LARGEST, CLOSE = 2048, 1
#: GPT-2's pre-tokenizer, as the byte-level file names it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with characters that two Unicode tables may class differently, or with runs so long that merging them takes a heap.
ODD, LONG = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]"), 1000
PROBE = "The mouse's  2 cats,\n\n ran'll (épée) to 12345 places!  "
_coders: dict = {}


class Coder:
    """Ids of whole texts as little-endian 32-bit bytes: those that `tokenizers` gives for a byte-level BPE file.

    Plain texts go through a faster engine that is built from the same file's vocabulary, whose ids are the order of its
    merges. When a worker loads the file, that order, a probe and every plain token of the vocabulary, alone and after a space
    and a letter, must get the same ids from both; where one does not, or a text is odd or holds an added token of the file,
    `tokenizers` itself encodes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = re.compile("(?!)")
        self.fast = self._fast(path)

    def _fast(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges, kind = file["model"]["vocab"], file["model"]["merges"], file.get("pre_tokenizer") or {}
        joined = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or file.get("normalizer") or None in joined or joined != sorted(joined):
            return None
        # byte-level files write each byte as a printable character: itself where it is one, else the next from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"] for t in file["added_tokens"]}
        self.added = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)")
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in special}
        fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        plain = [t for t in (bytes(to_byte[c] for c in token).decode("utf-8", "replace") for token in vocab if token not in special) if not ODD.search(t)]
        tried = [PROBE, *plain, *(f"{t} a{t}" for t in plain)]
        same = all(fast.encode_ordinary(t) == e.ids for t, e in zip(tried, self.model.encode_batch_fast(tried, add_special_tokens=False), strict=True) if not self.added.search(t))
        return fast if same else None

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = {i: t for i, t in enumerate(texts) if self.fast is None or ODD.search(t) or self.added.search(t) or max(map(len, t.split()), default=0) > LONG}
        slow = self.model.encode_batch_fast(list(odd.values()), add_special_tokens=False)
        out = {i: np.array(e.ids, dtype="<u4").tobytes() for i, e in zip(odd, slow, strict=True)}
        return [out[i] if i in odd else self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() for i, t in enumerate(texts)]


def coder(path: str) -> Coder:
    """One for each worker process and file."""
    if path not in _coders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _coders[path] = Coder(path)
    return _coders[path]


def lengths(n: int, largest: int = LARGEST) -> list[int]:
    """The pieces' lengths, longest first; they sum to n."""
    rest = n % largest
    return [largest] * (n // largest) + [1 << b for b in reversed(range(largest.bit_length())) if rest >> b & 1]


def pieces(docs: DataFrame, path: str, *, id_col="doc_id", text_col="text", largest: int = LARGEST, close: int = CLOSE, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) for every piece of every document."""
    ship(docs.sparkSession)
    end = np.array([close], dtype="<u4").tobytes()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def rows(batches):
        own = coder(path)
        for pdf in batches:
            out = []
            for key, ids in zip(pdf[id_col], own.encode(list(pdf[text_col])), strict=True):
                ids += end
                start, n = 0, len(ids) // 4
                for length in lengths(n, largest):
                    part = ids[4 * start : 4 * (start + length)]
                    out.append((key, start, length, zlib.crc32(part), n, *([part] * with_ids)))
                    start += length
            yield pd.DataFrame(out, columns=names)

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInPandas(rows, schema)


def pack(docs: DataFrame, path: str, *, id_col="doc_id", text_col="text", largest: int = LARGEST, close: int = CLOSE, with_ids: bool = False, group_rows: int = 200_000) -> DataFrame:
    """Pieces with sequence_id (gapless from 0; equal lengths are neighbours, longest first) and offset (0: a piece is alone)."""
    made = cut(pieces(docs, path, id_col=id_col, text_col=text_col, largest=largest, close=close, with_ids=with_ids))
    totals = made.groupBy("length").count().collect()  # one row a power of two
    salts = max(64, -(-sum(r["count"] for r in totals) // group_rows))
    made = made.withColumn("salt", F.pmod(F.xxhash64(F.col(id_col), F.col("start")), F.lit(salts)).cast("int"))
    at, first = 0, F.lit(0)
    for r in sorted(totals, key=lambda r: -r.length):
        first, at = F.when(F.col("length") == r.length, at).otherwise(first), at + r["count"]
    sums = made.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("salt") / 1024))
    above = sums.groupBy("length", "block").agg(F.sum("n").alias("all"))
    above = above.select("length", "block", (F.sum("all").over(Window.partitionBy("length").orderBy("block")) - F.col("all")).alias("above"))
    inner = F.sum("n").over(Window.partitionBy("length", "block").orderBy("salt")) - F.col("n")
    base = sums.withColumn("inner", inner).join(above, ["length", "block"]).select("length", "salt", (first.cast("long") + F.col("above") + F.col("inner")).alias("base"))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy(id_col, "start", "ids_crc32"))
    out = made.withColumn("place", place).join(base, ["length", "salt"])
    return out.withColumn("sequence_id", F.col("base") + F.col("place") - 1).withColumn("offset", F.lit(0).cast("long")).drop("base", "place", "salt")

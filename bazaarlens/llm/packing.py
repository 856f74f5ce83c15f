"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A document's ids are cut into full sequences and a tail.  A full sequence has no room for another piece, so its cost can't be
balanced; tails are dealt into groups by a hash of the document and its place in the input, so that rows which are alike
spread like others.  In a group they are taken by descending length, each going to the sequence of lowest estimated cost (a linear term plus a quadratic
one for attention inside the piece) that has room for all of it.  A group opens only as many sequences as its tokens fill;
tails that fit nowhere whole are cut over what room is left, so at most the last sequence of a group is padded.

Tokenization runs once, in the scan: only counts, checksums of full pieces and the ids of tails (2 bytes each) are shuffled.
"""

from __future__ import annotations

import heapq
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, encoded, split_words, table
from .features import give_back, pieces

LENGTH = 2048
END_ID = 1
#: Documents in a packing group, on average.
GROUP_DOCS = 4096
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n^2.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Pieces of words whose ids a task remembers.
REMEMBERED = 250_000
#: Bytes of text whose ids are laid out at once.
STEP = 4 << 20

#: The pattern by which the tokenizer file splits normalised text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Up to U+012F letters are lower-cased one for one and nothing composes; control characters and odd spaces are left out.
PLAIN = r"^[!-~¡-į]+$"

#: The characters that stand for bytes in the tokenizer's merges.  Printable ones stand for themselves.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}

TOKENS = "doc_id long, n_tokens long, full array<long>, tail binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Ids of single words.  The tokenizer never joins across white space, so a text's ids are its words' ids in order."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        contents = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        if any(c.split() != [c] for c in contents):
            raise ValueError("an added token with white space can't be found in words")
        self.added = "|".join(map(re.escape, contents))
        self.known: dict[str, bytes] = {"": b""}

    def plain(self, words: pa.Array) -> pa.Array:
        """Whether a word is lower-cased and split into PIECES as the tokenizer does it, each of which it merges by itself."""
        plain = pc.match_substring_regex(words, PLAIN)
        if self.added:  # found in raw or in normalised text, before the model's merges
            for text in (words, pc.utf8_lower(words)):
                plain = pc.and_not(plain, pc.match_substring_regex(text, self.added))
        return plain

    def forget(self) -> None:
        """Give the memory back at the end of a task: the worker may be kept for others."""
        self.known = {"": b""}

    def learn(self, names: list[str]) -> None:
        """Remember the ids of pieces, or of words that are not plain, as little-endian 16-bit numbers."""
        for piece, plain in zip(names, self.plain(pa.array(names, pa.large_string())).to_pylist(), strict=True):
            if plain:
                ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(BYTES))]
            else:
                ids = self.whole.encode(piece, add_special_tokens=False).ids
            self.known[piece] = array("H", ids).tobytes()

    def encode(self, words: pa.Array) -> pa.Array:
        """The ids of each word as little-endian 16-bit numbers, and after the last word the end id.

        The words are split by Arrow; Python sees each distinct piece once.
        """
        if len(self.known) > REMEMBERED:
            self.forget()
        cut = pc.replace_substring_regex(pc.utf8_lower(words), PIECES, r"\0 ")
        lists = pc.split_pattern(pc.if_else(self.plain(words), cut, words), " ")
        code, distinct = encoded(lists.values)
        names = distinct.to_numpy(zero_copy_only=False).tolist()
        self.learn([x for x in names if x not in self.known])
        raw, at = buffers(pa.array([self.known[x] for x in names], pa.large_binary()).take(pa.array(code)))
        ends = np.append(at[lists.offsets.to_numpy()] if len(words) else np.zeros(1, np.int64), len(raw) + 2)
        data = pa.py_buffer(raw.tobytes() + array("H", [END_ID]).tobytes())
        return pa.Array.from_buffers(pa.large_binary(), len(words) + 1, [None, pa.py_buffer(ends), data])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, as Spark keeps workers from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def document_ids(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each followed by the end id, and the range of each text."""
    flat, offsets = split_words(text)
    code, distinct = encoded(flat)
    words = tokenizer(path).encode(distinct)
    raw, at = buffers(words.take(pa.array(np.insert(code, offsets[1:], len(distinct)))))
    return raw.view("<u2"), at[offsets + np.arange(len(offsets))] // 2


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenized(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, STEP):
            ids, bounds = document_ids(batch.column(1), path)
            full, tails = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                cut = b - (b - a) % length
                full.append([checksum(ids[i : i + length]) for i in range(a, cut, length)])
                tails.append(ids[cut:b].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(full, pa.list_(pa.int64())), pa.array(tails, pa.binary())], names=["doc_id", "n_tokens", "full", "tail"])
        tokenizer(path).forget()
        give_back()

    return run


def assign(lengths: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(item, start in it, length, sequence): items by descending length to the cheapest sequence with room for them."""
    order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: -lengths[i])
    count = math.ceil(sum(lengths) / length)
    room, cost = [length] * count, [0.0] * count
    ready = [(0.0, s) for s in range(count)]
    parked: list[tuple[int, int]] = []  # by room, the largest first: too full for the lengths of now
    out, left = [], []
    for i in order:
        n = lengths[i]
        while parked and -parked[0][0] >= n:
            s = heapq.heappop(parked)[1]
            heapq.heappush(ready, (cost[s], s))
        while ready and room[ready[0][1]] < n:
            s = heapq.heappop(ready)[1]
            if room[s]:
                heapq.heappush(parked, (-room[s], s))
        if not ready:
            left.append(i)
            continue
        s = ready[0][1]
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n
        heapq.heapreplace(ready, (cost[s], s))
        out.append((i, 0, n, s))
    open_ = sorted((s for s in range(count) if room[s]), key=lambda s: (cost[s], s), reverse=True)
    for i in left:
        at = 0
        while at < lengths[i]:
            s = open_[-1]
            n = min(room[s], lengths[i] - at)
            out.append((i, at, n, s))
            room[s] -= n
            at += n
            if not room[s]:
                open_.pop()
    return out


def _packed(length: int, linear: float, quadratic: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        number = group["group"][0].as_py() << 32
        ids, tokens, full, tails = (group[c].to_pylist() for c in ("doc_id", "n_tokens", "full", "tail"))
        tails = [np.frombuffer(x, "<u2") for x in tails]
        rows, used = [], [0] * math.ceil(sum(map(len, tails)) / length)
        for i, at, n, s in assign([len(x) for x in tails], length, linear, quadratic):
            start = tokens[i] - len(tails[i]) + at
            rows.append((ids[i], start, n, checksum(tails[i][at : at + n]), tokens[i], number + s, used[s]))
            used[s] += n
        s = number + len(used)
        for i, crcs in enumerate(full):
            for k, crc in enumerate(crcs):
                rows.append((ids[i], k * length, length, crc, tokens[i], s, 0))
                s += 1
        names = [x.split()[0] for x in PACKED.split(", ")]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)

    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC, group_docs: int = GROUP_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text (null: none) and one end id; every id is in one piece.  A document of an empty
    text has the end id alone.  Repeated rows are packed each by itself; a null id is kept.  An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    groups = max(1, math.ceil(rows.count() / group_docs))
    tokens = rows.mapInArrow(_tokenized(tokenizer_path, length), TOKENS)
    # the number of groups salts the hash: a group number is not the hash by which Spark deals rows
    place = F.monotonically_increasing_id()
    grouped = tokens.withColumn("group", F.pmod(F.xxhash64("doc_id", "n_tokens", place, F.lit(groups)), F.lit(groups)))
    return grouped.groupBy("group").applyInArrow(_packed(length, linear, quadratic), PACKED)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

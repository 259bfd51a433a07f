"""Encoding a corpus with a public byte-level BPE tokenizer.

Method: corpus-level merge replay. Texts are split into words once; each task
numbers the words of a stretch of texts and writes numbers and words. The
distinct words of the whole corpus are then dealt to tasks, each of which lays
their bytes' symbols out as linked positions, keeps an inverted index from
symbol pair to positions, and replays all merges in rank order; a merge touches
only the neighbours of the places it changes. So a word is replayed once,
however many texts it is in. Last, each stretch gets the ids of its words and
turns numbers into ids. Word occurrences are shuffled as numbers, never as text.

Null and empty texts give an empty list. Strings that look like special tokens
are ordinary text. Every row gives one row, also a repeated one. An empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kildespor.plans.shared import written

#: Characters of text that are numbered together, and characters of words that are replayed together.
STRETCH = 4_000_000
REPLAYED = 2_000_000

#: Fixed value: how the vocabulary's texts were split before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary file: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def _require_byte_level(file: dict) -> None:
    """Raise ValueError for a tokenizer that prepares texts otherwise than SPLIT does, or merges otherwise than by rank."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    wanted = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    extras = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or file.get("normalizer") or not wanted or extras:
        raise ValueError("only byte-level BPE without a normalizer is supported")


class MergeTable:
    """Ids of the bytes, and for a pair of ids its rank and the id it becomes."""

    def __init__(self, file: bytes):
        whole = json.loads(file)
        model = whole["model"]
        _require_byte_level(whole)
        vocab = model["vocab"]
        self.of_byte = [vocab[c] for c in byte_symbols()]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])


def replay(words: list[str], table: MergeTable) -> list[list[int]]:
    """The ids of each word, by replaying merges over all words together."""
    ids: list[int] = []
    first, ends = [], []
    of_byte = table.of_byte
    for w in words:
        first.append(len(ids))
        ids.extend([of_byte[b] for b in w.encode("utf-8", "surrogatepass")])
        ends.append(len(ids))
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for a, b in zip(first, ends):
        if a < b:
            before[a] = -1
            after[b - 1] = -1
    pairs, places, heap = table.pairs, defaultdict(list), []
    for i in range(n):
        j = after[i]
        if j >= 0 and (ids[i], ids[j]) in pairs:
            places[ids[i], ids[j]].append(i)
    heap = [(pairs[p][0], p) for p in places]
    heapq.heapify(heap)
    while heap:
        _, pair = heapq.heappop(heap)
        a, b = pair
        made = pairs[pair][1]
        at = places.pop(pair, None)
        if not at:
            continue
        at.sort()  # overlapping pairs merge from the left
        for i in at:
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            k, h = after[j], before[i]
            ids[i], ids[j] = made, -1
            after[i] = k
            if k >= 0:
                before[k] = i
                new = (made, ids[k])
                if new in pairs:
                    if new not in places:
                        heapq.heappush(heap, (pairs[new][0], new))
                    places[new].append(i)
            if h >= 0:
                new = (ids[h], made)
                if new in pairs:
                    if new not in places:
                        heapq.heappush(heap, (pairs[new][0], new))
                    places[new].append(h)
    return [[x for x in ids[a:b] if x >= 0] for a, b in zip(first, ends)]


def _numbered(id_type: pa.DataType):
    """Rows (id, text) to rows (stretch, id, words) of numbers, and one row (stretch, vocabulary) for each stretch."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, task = regex.compile(SPLIT), TaskContext.get().partitionId()

        def flush(n: int, keys: list, texts: list):
            known: dict[str, int] = defaultdict(lambda: len(known))
            numbers, ends = [], [0]
            for t in texts:
                if t:
                    numbers.extend([known[w] for w in split.findall(t)])
                ends.append(len(numbers))
            rows = len(texts)
            words = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(numbers, np.int32)))
            names, count = ["stretch", "id", "words", "vocabulary"], pa.array([f"{task}-{n}"])
            stretch = count.take(pa.array(np.zeros(rows, np.int64)))
            yield pa.RecordBatch.from_arrays([stretch, pa.concat_arrays(keys), words, pa.nulls(rows, pa.list_(pa.string()))], names)
            yield pa.RecordBatch.from_arrays([count, pa.nulls(1, id_type), pa.nulls(1, words.type), pa.array([list(known)], pa.list_(pa.string()))], names)

        n, keys, texts, size = 0, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                new = piece.column(1).to_pylist()
                keys.append(piece.column(0))
                texts += new
                size += sum(len(t) for t in new if t)
                if size >= STRETCH:
                    yield from flush(n, keys, texts)
                    n, keys, texts, size = n + 1, [], [], 0
        if keys:
            yield from flush(n, keys, texts)

    return number


def _replayed(file):
    """Distinct words to (word, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = None, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(replay(held, table), pa.list_(pa.int32()))], ["word", "ids"])

        for batch in batches:
            table = table or MergeTable(file.value)
            for w in batch.column(0).to_pylist():
                held.append(w)
                size += len(w)
                if size >= REPLAYED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _as_ids(only_counts: bool):
    """A stretch's rows (id, words) and its words (number, ids) to (id, ids) or (id, n_tokens)."""

    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        lists = words["ids"].combine_chunks()
        order = np.argsort(words["number"].to_numpy())
        size = np.zeros(len(order), np.int64) if not len(order) else lists.value_lengths().to_numpy()[order].astype(np.int64)
        numbers = rows["words"].combine_chunks()
        flat = numbers.flatten().to_numpy()
        ends = np.r_[0, np.cumsum(numbers.value_lengths().to_numpy())]
        upto = np.r_[0, np.cumsum(size[flat])]
        if only_counts:
            return pa.table({"id": rows["id"], "n_tokens": pa.array(np.diff(upto[ends]))})
        ids = lists.take(pa.array(order)).flatten().to_numpy() if len(order) else np.zeros(0, np.int32)
        start = np.r_[0, np.cumsum(size)][:-1] if len(order) else size
        at = np.repeat(start[flat] - upto[:-1], size[flat]) + np.arange(upto[-1])
        values = pa.array(ids[at].astype(np.int32))
        return pa.table({"id": rows["id"], "ids": pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), values)})

    return run


def encoded(df: DataFrame, key: str, text: str, file: str, only_counts: bool = False) -> DataFrame:
    """(id, ids) of every row, or (id, n_tokens); ``key`` is a column that stands for the row and may be a struct.

    ``file`` is the tokenizer's JSON file, read by the driver and broadcast
    (under 2 MB); one that isn't plain byte-level BPE is a ValueError.
    """
    with open(file, "rb") as f:
        content = f.read()
    MergeTable(content)
    shared = df.sparkSession.sparkContext.broadcast(content)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    number = _numbered(to_arrow_type(df.schema[key].dataType))
    pieces = written(rows.mapInArrow(number, f"stretch string, id {kind}, words array<int>, vocabulary array<string>"))
    vocabulary = pieces.where("vocabulary is not null").select("stretch", F.posexplode("vocabulary").alias("number", "word"))
    words = written(vocabulary.select("word").distinct().mapInArrow(_replayed(shared), "word string, ids array<int>"))
    known = vocabulary.join(words, "word").select("stretch", "number", "ids")
    texts = pieces.where("vocabulary is null").select(F.col("stretch").alias("part"), "id", "words")
    out = "n_tokens bigint" if only_counts else "ids array<int>"
    return texts.groupBy("part").cogroup(known.groupBy("stretch")).applyInArrow(_as_ids(only_counts), f"id {kind}, {out}")

"""BPE encoding and decoding by a priority queue of merge ranks over a doubly linked symbol list.

A word begins as one symbol a byte, the last one marked as the word's end. Neighbours that the model
merges are put in a queue by rank, then place; the best one is taken, its two symbols become one, and
the pairs with its new neighbours are queued. An entry whose symbols have changed since is stale and
passed over. The work for a word of n bytes grows as n log n, so long words need no cut.

The model file says how a text becomes words: composed (NFC), lower case, white space dropped; the
model's library does this much, and tells letters, numbers and white space apart. Special tokens are
looked for in the text as it stands. Decoding puts the vocabulary's strings
together, with one space between, as the file names no decoder.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from logmere.llm.common import ship_package

MODEL = "word_bpe_49k.json"
#: Words remembered; those not met again while as many new ones come are forgotten.
REMEMBERED = 250_000
#: Longer words are searched each time they come.
MOST_REMEMBERED = 64
ROWS_AT_ONCE, CHARS_AT_ONCE = 500, 2_000_000

#: What the model file must say for the rules below to hold.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}


def named(model: str) -> str:
    """The path of a model file: as given, or that of a public tokenizer of this name."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def byte_letters() -> list[str]:
    """A printable character for each byte: itself, or for the others the ones from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + others.index(b)) for b in range(256)]


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern:
    """``WORDS`` with its kinds of characters spelled out as the model's library tells them apart."""
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)

    def kind(name: str) -> str:
        runs = pre_tokenizers.Split(Regex(f"{name}+"), "removed", invert=True).pre_tokenize_str(every)
        return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for run, _ in runs)

    letters, numbers, white = map(kind, ("\\p{L}", "\\p{N}", "\\s"))
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+"
    )


#: The same for texts of ASCII alone.
ASCII_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\x09-\\x0D a-z0-9]+")


class WordPieces:
    """The vocabulary and merges of a model, and the words met of late."""

    def __init__(self, model: str) -> None:
        spec = json.loads(model)
        bpe, split = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        fine = (
            bpe["type"] == "BPE"
            and (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS
            and split[0] == SPLIT
            and [s.get("type") for s in split[1:]] == ["ByteLevel"]
            and not (split[1]["add_prefix_space"] or split[1]["use_regex"])
            and not (bpe["continuing_subword_prefix"] or bpe["dropout"] or bpe["ignore_merges"])
            and spec["decoder"] is None
            and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not fine:
            raise ValueError("a model of another kind than this encoder is made for")
        self.normalizer = Tokenizer.from_str(model).normalizer
        vocabulary, suffix = bpe["vocab"], bpe["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = [vocabulary[c] for c in letters]
        self.last = [vocabulary[c + suffix] for c in letters]
        #: For a pair of symbols (two 32-bit numbers in one), rank and merged symbol likewise.
        self.merges: dict[int, int] = {}
        for rank, (a, b) in enumerate(bpe["merges"]):
            self.merges[vocabulary[a] << 32 | vocabulary[b]] = rank << 32 | vocabulary[a + b]
        self.special = {t["content"]: array("i", [t["id"]]).tobytes() for t in spec["added_tokens"]}
        found = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.specials = re.compile(f"({found})") if found else None
        by_id = {k: t for t, k in vocabulary.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.strings = [by_id.get(k, "") for k in range(max(by_id) + 1)]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def search(self, word: str) -> bytes:
        """The ids of a word as 32-bit numbers."""
        raw = word.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        size, merges = len(symbols), self.merges
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        queue = []
        for at in range(size - 1):
            merge = merges.get(symbols[at] << 32 | symbols[at + 1])
            if merge is not None:
                queue.append((merge, at))
        heapq.heapify(queue)
        while queue:
            merge, at = heapq.heappop(queue)
            right = after[at]
            # Stale: the symbol here was taken by its left neighbour, or one of the two has changed.
            if symbols[at] < 0 or right == size or merges.get(symbols[at] << 32 | symbols[right]) != merge:
                continue
            symbols[at], symbols[right] = merge & 0xFFFFFFFF, -1
            left, right = before[at], after[right]
            after[at] = right
            if right < size:
                before[right] = at
                merge = merges.get(symbols[at] << 32 | symbols[right])
                if merge is not None:
                    heapq.heappush(queue, (merge, at))
            if left >= 0:
                merge = merges.get(symbols[left] << 32 | symbols[at])
                if merge is not None:
                    heapq.heappush(queue, (merge, left))
        return array("i", [s for s in symbols if s >= 0]).tobytes()

    def __getitem__(self, word: str) -> bytes:
        """The ids of a word that isn't among those met of late."""
        ids = self.before.get(word) or self.search(word)
        if len(word) <= MOST_REMEMBERED:
            self.known[word] = ids
        return ids

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        return word_pattern().findall(self.normalizer.normalize_str(text))

    def encode(self, text: str) -> np.ndarray:
        parts = self.specials.split(text) if self.specials else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part])
            elif part:
                known = self.known.get
                out.extend([known(w) or self[w] for w in self.words(part)])
        if len(self.known) >= REMEMBERED:
            self.before, self.known = self.known, {}
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def loaded(model: str) -> WordPieces:
    """One for each worker process, with the words it remembers."""
    return WordPieces(model)


def _model(rows: DataFrame, model: str):
    ship_package(rows.sparkSession)
    with open(named(model), encoding="utf-8") as file:
        return rows.sparkSession.sparkContext.broadcast(file.read())


def few_at_once(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """Parts of a batch: many rows, or few very long ones."""
    low = total = 0
    for k, size in enumerate(pc.fill_null(sizes, 0).to_pylist()):
        if k - low == ROWS_AT_ONCE or (k > low and total + size > CHARS_AT_ONCE):
            yield batch.slice(low, k - low)
            low, total = k, 0
        total += size
    if batch.num_rows > low:
        yield batch.slice(low)


def encode(
    docs: DataFrame, model: str = MODEL, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id, ids`` for each row of ``docs``.

    The ids are those of the model file's own library without added special tokens, truncation or
    padding; special tokens that stand in a text are found. A null or empty text has no ids, nor has
    one of white space. Words and texts of any length are taken whole; repeated rows are encoded
    alike, null ids stay; further columns go. An empty table gives no rows. The model file is read
    on the driver and broadcast (a file of some megabytes).
    """
    given = _model(docs, model)
    kinds = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(given.value)
        for whole in batches:
            for batch in few_at_once(whole, pc.utf8_length(whole.column("text"))):
                found = [pieces.encode(t or "") for t in batch.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, found)])
                values = np.concatenate(found)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column("id"), ids], schema=kinds)

    rows = docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")
    )
    return rows.mapInArrow(run, "id long, ids array<int>")


def decode(
    encoded: DataFrame, model: str = MODEL, ids_column: str = "ids", to: str = "text"
) -> DataFrame:
    """``encoded`` with the text of its ids as a further column ``to``, in place of one of this name.

    Special tokens are written out. Null ids give a null text, no ids an empty one.
    """
    given = _model(encoded, model)
    encoded = encoded.drop(to) if to != ids_column else encoded
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(given.value)
        for whole in batches:
            for batch in few_at_once(whole, pc.list_value_length(whole.column(ids_column))):
                column = batch.column(ids_column)
                texts = [pieces.decode(x.values.to_numpy()) if x.is_valid else None for x in column]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(texts, pa.string())], names=[*names, to]
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, `{to}` string")


def encoded_and_decoded(docs: DataFrame, model: str = MODEL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, ids, text``: both steps, one after the other."""
    return decode(encode(docs, model, id_column, text_column), model)

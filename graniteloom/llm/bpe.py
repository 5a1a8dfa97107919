"""Byte-level BPE: encoding with a priority queue of merge ranks over a doubly linked symbol list, and decoding.

The vocabulary is read from a tokenizer file (JSON of kind BPE with the ByteLevel pre-tokenizer); nothing is trained.
Its tables have a fixed size, so they are broadcast. Texts are encoded whole, in the task that reads them: nothing
is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteloom.llm.common import documents

#: Fixed value: the byte-level pre-tokenizer's pattern, with white space as Unicode's property of that name.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

#: Words of a generation that a worker remembers (it keeps two), and the longest word (bytes) that is remembered.
REMEMBERED = 220_000
LONGEST = 64

#: Characters of text a worker encodes before it hands rows on.
SLICE_CHARS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by the rule that bytes which
    print stand for themselves and the others follow from code point 256 on."""
    prints = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    out, more = {}, 256
    for b in range(256):
        out[chr(b if b in prints else more)] = b
        more += b not in prints
    return out


def load_vocabulary(path: str) -> dict:
    """Plain tables of a tokenizer file: merge ranks by pair, the symbol each rank makes, bytes by id, added strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec["pre_tokenizer"]
    odd = [k for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "unk_token") if model.get(k)]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or odd or model.get("ignore_merges"):
        raise ValueError("only plain byte-level BPE without prefix space or normalizer is supported")
    alphabet, ids = byte_alphabet(), model["vocab"]
    size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    strings = [b""] * size
    for token, i in ids.items():
        strings[i] = bytes(alphabet[c] for c in token)
    added = {}
    for token in spec["added_tokens"]:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError("added tokens must be plain strings")
        added[token["content"]] = token["id"]
        strings[token["id"]] = token["content"].encode()
    ranks, made = {}, []
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        ranks[ids[left] * size + ids[right]] = rank
        made.append(ids[left + right])
    single = [0] * 256
    for c, b in alphabet.items():
        single[b] = ids[c]
    return {"ranks": ranks, "made": made, "strings": strings, "single": single, "added": added, "size": size, "known": [{}, {}], "chunks": [{}, {}]}


def merged(raw: bytes, t: dict) -> list[int]:
    """The symbols of raw after all merges, lowest rank first and leftmost first among equals.

    Each heap entry is a rank and a position in one integer. An entry is stale, and skipped, if the pair now at its
    position has another rank, or none because its symbol was merged away.
    """
    single, n = t["single"], len(raw)
    symbols = [single[b] for b in raw]
    ranks, made, size = t["ranks"].get, t["made"], t["size"]
    bits = n.bit_length()
    mask = (1 << bits) - 1
    heap = [(r << bits) | i for i, (a, b) in enumerate(pairwise(symbols)) if (r := ranks(a * size + b)) is not None]
    if not heap:
        return symbols
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols.append(-1)
    while heap:
        entry = heappop(heap)
        i = entry & mask
        a = symbols[i]
        if a < 0:
            continue
        j = after[i]
        rank = entry >> bits
        if j >= n or ranks(a * size + symbols[j]) != rank:
            continue
        a = symbols[i] = made[rank]
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks(a * size + symbols[k])
            if rank is not None:
                heappush(heap, (rank << bits) | i)
        h = before[i]
        if h >= 0:
            rank = ranks(symbols[h] * size + a)
            if rank is not None:
                heappush(heap, (rank << bits) | h)
    return [s for s in symbols if s >= 0]


class Memory:
    """A mapping of two generations: a full one becomes the old one, and what is asked for again comes back from it."""

    def __init__(self, generations: list[dict]):
        self.generations = generations
        self.get = generations[0].get

    def put(self, key: str, value: list[int]) -> None:
        if len(self.generations[0]) >= REMEMBERED:
            self.generations[:] = [{}, self.generations[0]]
            self.get = self.generations[0].get
        self.generations[0][key] = value

    def recall(self, key: str) -> list[int] | None:
        value = self.generations[1].get(key)
        if value is not None:
            self.put(key, value)
        return value


class Encoder:
    """encode() and decode() over the tables of load_vocabulary."""

    def __init__(self, tables: dict):
        import regex

        self.tables, self.known, self.chunks = tables, Memory(tables["known"]), Memory(tables["chunks"])
        self.odd_space = re.compile(r" \s").search
        self.words = regex.compile(PATTERN).findall
        added = sorted(tables["added"], key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def word(self, word: str) -> list[int]:
        out = self.known.get(word) or self.known.recall(word)
        if out is None:
            raw = word.encode()
            out = merged(raw, self.tables)
            if len(raw) <= LONGEST:
                self.known.put(word, out)
        return out

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a space and the stretch after it, which the pre-tokenizer cuts by itself."""
        out = self.chunks.get(chunk) or self.chunks.recall(chunk)
        if out is None:
            out = []
            for word in self.words(" " + chunk):
                out += self.word(word)
            if len(chunk) <= LONGEST:
                self.chunks.put(chunk, out)
        return out

    def _encode(self, text: str, add) -> None:
        # A space belongs to what follows it, so a text can be cut there, unless white space follows.
        if text[-1:] == " " or self.odd_space(text):
            for word in self.words(text):
                add(self.word(word))
            return
        first, *chunks = text.split(" ")
        for word in self.words(first):
            add(self.word(word))
        for chunk in chunks:
            add(self.chunks.get(chunk) or self.chunk(chunk))

    def encode(self, text: str) -> np.ndarray:
        out: list[int] = []
        pieces = self.added.split(text) if self.added and any(a in text for a in self.tables["added"]) else [text]
        for at, piece in enumerate(pieces):
            if at % 2:
                out.append(self.tables["added"][piece])
            else:
                self._encode(piece, out.extend)
        return np.array(out, dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary strings of ids, one after another; bytes that are no UTF-8 become U+FFFD."""
        strings = self.tables["strings"]
        return b"".join([strings[i] for i in ids.tolist()]).decode("utf-8", "replace")


def _listed(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.array([], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of rows whose lengths sum to about `most` at most; a longer row is a run of its own."""
    begin = total = 0
    for at, n in enumerate(lengths):
        if at > begin and total + n > most:
            yield begin, at
            begin, total = at, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def encode(docs: DataFrame, vocabulary: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the array<int> column `ids` in place of any column of that name: the token ids of each whole text.

    vocabulary: path of the tokenizer file on the driver. A null or empty text gets no ids. Added strings of the file
    (such as end-of-text marks) found in a text become their own ids. Rows are independent: repeated rows repeat
    their ids, an empty table gives an empty one, and other columns pass through. With `decoded`, a column of that
    name holds what decode() makes of the ids, so that a round trip needs one pass and one worker.
    """
    tables = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    body = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"))
    made = [ids, *([decoded] if decoded else [])]
    schema = T.StructType([body.schema["row"], T.StructField(ids, T.ArrayType(T.IntegerType())), *(T.StructField(c, T.StringType()) for c in made[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in batches:
            texts = batch.column(0).field(keep.index(text)).cast(pa.string()).fill_null("")
            for begin, end in _slices(pa.compute.utf8_length(texts).to_pylist(), SLICE_CHARS):
                found = [encoder.encode(t) for t in texts.slice(begin, end - begin).to_pylist()]
                columns = [batch.column(0).slice(begin, end - begin), _listed(found)]
                if decoded:
                    columns.append(pa.array([encoder.decode(a) for a in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["row", *made])

    return body.mapInArrow(run, schema).select("row.*", *made)


def decode(rows: DataFrame, vocabulary: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the string column `text` in place of any column of that name, decoded from the array column `ids`.

    Null ids give an empty text.
    """
    tables = rows.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    keep = [c for c in rows.columns if c != text]
    given = F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>"))
    body = rows.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), given.alias("ids"))
    schema = T.StructType([body.schema["row"], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in batches:
            lists = batch.column(1)
            for begin, end in _slices(pa.compute.list_value_length(lists).to_pylist(), SLICE_CHARS):
                part = lists.slice(begin, end - begin)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(pa.compute.list_value_length(part).to_numpy(zero_copy_only=False))
                found = [encoder.decode(a) for a in np.split(flat, ends[:-1])] if len(part) else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(found, pa.string())], ["row", text])

    return body.mapInArrow(run, schema).select("row.*", text)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of rows with ids and decoded."""
    return rows.select(
        *key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of the token ids, and of the text decoded from them, of every document."""
    return digests(encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary_path(), decoded="decoded"), ["doc_id"])

"""Best-fit packing of token ids into sequences, certified by lower bounds.

Texts become ids, ids become pieces of at most a sequence, and pieces are written once with a key. Only keys and lengths
are packed: dealt by a hash of the key into parts of a bounded size, each part packed by best-fit decreasing. Lower
bounds by dual-feasible functions of the lengths certify a part whose number of bins equals its bound, and the whole by
the same bound of all lengths. As long as the whole has a gap, parts with one give away the pieces of their emptier bins,
the others those of their emptiest bin; these are dealt anew, so that pieces of different parts meet, and packed again,
round after round while that saves bins. The ids never leave their table; pieces that fill a sequence are never packed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteloom.llm.common import documents, fields_of, forget, kept, row_of, text_of, written

#: Tokens of a sequence, the id that ends a document, pieces of a part, rounds of exchange at most.
CAPACITY, END, PART, ROUNDS = 4096, 1, 8192, 8
#: Characters encoded at a time, and strings that a task remembers before it begins anew.
SLICE_CHARS, WORDS = 4 << 20, 400_000
#: What the vocabulary's tokens have at the end of a word.
WORD_END = "</w>"
#: Letters below this have small forms that are letters; ASCII signs that end a string behind such a letter.
LATIN, SIGNS = "\u0250", "([a-z\u00df-\u00f6\u00f8-\u00ff])" + r"([!-/:-@\[-`{-~]+)(\s|$)"


class WordIds:
    """Ids of the tokenizers library, asked once for each string between two runs of white space.

    The vocabulary's pre-tokenizer drops white space and never joins what it parts, so the ids of a text are those of its
    strings one after the other. Known strings have a slot in a pool of ids, which begins anew when it is full.
    """

    def __init__(self, vocabulary: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end = end
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(1 + max(vocab.values(), default=0), dtype=bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        """Slot 0 is the end id."""
        self.slots: dict[str, int] = {}
        self.pool, self.starts, self.lengths = np.array([self.end], dtype=np.uint32), np.array([0]), np.array([1])

    def slots_of(self, words: list[str]) -> np.ndarray:
        if len(self.lengths) > WORDS:
            self.forget()
        found = np.fromiter((self.slots.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            asked = [words[i] for i in new.tolist()]
            # One word of letters ends where its only word end is, so such words are asked for together.
            plain = np.fromiter((w.isalpha() and (w.isascii() or (max(w) < LATIN and w.lower().isalpha())) for w in asked), dtype=bool, count=len(asked))
            order = np.argsort(~plain, kind="stable")
            asked, new, k = [asked[i] for i in order.tolist()], new[order], int(plain.sum())
            together, _ = self._ask([" ".join(asked[at : min(k, at + 256)]) for at in range(0, k, 256)])
            stops = np.flatnonzero(self.ends_word[together]) + 1
            if len(stops) != k:  # a vocabulary that marks the ends of words in another way
                together, lengths = self._ask(asked[:k])
                stops = np.cumsum(lengths)
            alone = self._ask(asked[k:])
            lengths = np.concatenate([np.diff(stops, prepend=0), alone[1]])
            flat = np.concatenate([together, alone[0]])
            found[new] = np.arange(len(self.lengths), len(self.lengths) + len(new))
            self.slots.update(zip(asked, found[new].tolist(), strict=True))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
            self.lengths, self.pool = np.concatenate([self.lengths, lengths]), np.concatenate([self.pool, flat])
        return found

    def _ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of each text."""
        ids = [e.ids for at in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(lengths.sum())), lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, each text's followed by the end id; and the number of each text."""
        # Signs behind a letter at a string's end are words of their own, and capitals are made small anyway; set apart and
        # small, far fewer strings are distinct. Texts that may name special tokens stay as they are.
        simple = pc.replace_substring_regex(pc.ascii_lower(texts), SIGNS, r"\1 \2\3")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, simple))
        coded = lists.flatten().dictionary_encode()
        slots = self.slots_of(coded.dictionary.to_pylist())
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        order = np.insert(slots[coded.indices.to_numpy(zero_copy_only=False)], ends, 0)
        upto = np.cumsum(self.lengths[order])
        pool = pa.LargeListArray.from_arrays(pa.array(np.append(self.starts, len(self.pool))), pa.array(self.pool))
        flat = pool.take(pa.array(order)).flatten().to_numpy()
        return flat, np.diff(np.concatenate([[0], upto[ends + np.arange(len(ends))]]))


@lru_cache(maxsize=1)
def _word_ids(vocabulary: str, end: int) -> WordIds:
    """One for each worker process: what a task has learnt serves the next."""
    return WordIds(vocabulary, end)


def pieces(docs: DataFrame, keep: list[str], vocabulary: str, *, text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """keep, piece, start, length and ids (4 bytes each, little-endian) of each piece of each text.

    A null or empty text is the end id alone. Only documents of more than `capacity` ids are cut, into pieces of that
    many; the last may be shorter. Rows are independent: null and repeated ids and repeated rows change nothing. An empty
    table gives an empty one. A column of keep with the name of a result gives way to it.
    """
    made = ["piece", "start", "length", "ids"]
    stay = kept(keep, *made)
    body = docs.select(row_of(stay).alias("row"), text_of(text).alias("text"))
    schema = T.StructType([body.schema["row"], *(T.StructField(c, t()) for c, t in zip(made, (T.IntegerType, T.LongType, T.LongType, T.BinaryType), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _word_ids(vocabulary, end)
        for batch in batches:
            sizes = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False) + 1)
            at = 0
            while at < len(batch):
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_CHARS, "right")))
                given = batch.slice(at, stop - at)
                at = stop
                flat, counts = encoder.encode(given.column(1))
                number = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(counts[row] - start, capacity)
                bounds = np.concatenate([[0], np.cumsum(length)]) * 4
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())])
                for k in range(0, len(row), 4096):
                    part = slice(k, k + 4096)
                    columns = [given.column(0).take(pa.array(row[part])), pa.array(piece[part], pa.int32()), pa.array(start[part]), pa.array(length[part])]
                    yield pa.RecordBatch.from_arrays([*columns, ids.slice(k, 4096).cast(pa.binary())], schema.names)

    return body.mapInArrow(run, schema).select(*fields_of("row", stay), *made)


def lower_bound(counts: np.ndarray) -> int:
    """Least number of bins that any packing needs; counts[x] pieces have length x, the capacity is the last index.

    Dual-feasible functions f keep sum f(x) <= C for all x in one bin, so ceil(sum f(x) / C) bins are needed at least.
    Taken: for each t up to C / 2, lengths below t as 0 and those above C - t as C; and for each k, steps of C / k.
    """
    c = len(counts) - 1
    x = np.arange(c + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // c)
    upto, mass = np.cumsum(counts), np.cumsum(counts * x)
    t = np.arange(1, c // 2 + 1)
    large = upto[c] - upto[c - t]
    middle = mass[c - t] - mass[t - 1]
    if len(t):
        best = max(best, int((large + -(-middle // c)).max()))
    for k in range(1, min(32, c) + 1):
        # In units of C / k: x (k + 1) / C where that is whole stays x, else its floor times C / k.
        product = (k + 1) * x
        steps = np.where(product % c == 0, x * k, product // c * c)
        best = max(best, -(-int((counts * steps).sum()) // (k * c)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the free room of each bin: longest first, each into the fullest bin that holds
    it. Bins lie by free room; a bit set of the rooms that occur finds the next one in one step."""
    bin_, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = capacity, len(free)
            free.append(capacity)
        bin_[i], offset[i] = at, capacity - room
        left = room - size
        free[at] = left
        if left:
            by_room[left].append(at)
            rooms |= 1 << left
    return bin_, offset, np.array(free, dtype=np.int64)


def _packed(open_: DataFrame, parts: int, round_: int, capacity: int) -> DataFrame:
    """key, length, part, bin, offset, given (whether the piece is given away) and gap (of its part) of each piece."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "key"], kind="stable")
        lengths = group["length"].to_numpy()
        at, offset, free = best_fit_decreasing(lengths, capacity)
        gap = len(free) - lower_bound(np.bincount(lengths, minlength=capacity + 1))
        # A part above its bound gives away what lies in bins with more room than its average. One that meets it still
        # rounds up to a whole bin, and gives away its emptiest.
        given = (free > free.mean() if gap else np.arange(len(free)) == free.argmax()) & (free > 0)
        return pd.DataFrame({"key": group["key"], "length": lengths, "part": group["part"], "bin": at.astype("int32"), "offset": offset, "given": given[at], "gap": np.int32(gap)})

    dealt = open_.select("key", "length", F.pmod(F.xxhash64(F.lit(round_), "key"), F.lit(parts)).cast("int").alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, "key long, length long, part int, bin int, offset long, given boolean, gap int")


def layout(lengths: DataFrame, *, capacity: int = CAPACITY, part: int = PART, rounds: int = ROUNDS) -> DataFrame:
    """key, sequence_id and offset of each row of lengths (key long, length long from 1 to capacity; keys are unique).

    Sequences are gapless from 0. A part has about `part` pieces, so no task grows with the input. Each round's new
    packing of the pieces given away is taken only where it needs fewer bins than they had. An empty table gives an
    empty one.
    """
    done = [lengths.where(F.col("length") >= capacity).select("key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    open_ = lengths.where(F.col("length") < capacity).select("key", "length")
    # Lengths are below the capacity, so this is a short list.
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in open_.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    bound, left = lower_bound(counts), int(counts.sum())
    packed, of, total, given = None, 0, 0, 0
    for round_ in range(rounds + 1):
        if left == 0 or total == bound:
            break
        new = written(_packed(open_, -(-left // part), round_, capacity))
        bins = new.groupBy("part", "bin").agg(F.first("given").alias("given"), F.count(F.lit(1)).alias("n"))
        bins = bins.agg(F.count(F.lit(1)).alias("bins"), F.count_if("given").alias("given"), F.coalesce(F.sum(F.when(F.col("given"), F.col("n"))), F.lit(0)).alias("left")).first()
        if packed is not None and bins["bins"] >= given:
            forget(new)  # no bin saved: what was given away stays where it was
            break
        if packed is not None:
            done.append(_named(packed.where("NOT given"), of))
        packed, of, total, given, left = new, round_, total - given + bins["bins"], bins["given"], bins["left"]
        open_ = packed.where("given").select("key", "length")
    if packed is not None:
        done.append(_named(packed, of))
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out


def _named(packed: DataFrame, round_: int) -> DataFrame:
    """Sequence numbers that no other round, part or bin has: a round's parts and a part's bins are below 2^28."""
    number = F.lit(round_).cast("long") * F.lit(1 << 56) + F.col("part").cast("long") * F.lit(1 << 28) + F.col("bin")
    return packed.select("key", number.alias("sequence_id"), "offset")


def keyed(cut: DataFrame) -> DataFrame:
    """Pieces, written, with a key of their own."""
    return written(cut.withColumn("key", F.monotonically_increasing_id()))


def sequences(cut: DataFrame, laid: DataFrame) -> DataFrame:
    """sequence_id, length and ids (4 bytes each) of each sequence: keyed pieces (see keyed) laid out (see layout). A
    sequence holds `capacity` pieces at most, so no group grows with the input."""
    placed = cut.select("key", "ids", "length").join(laid, "key").groupBy("sequence_id")
    gathered = placed.agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return gathered.select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document, with the checksum of its ids."""
    cut = keyed(pieces(documents(spark, sf_dir), ["doc_id"], vocabulary_path()))
    laid = layout(cut.select("key", "length"))
    digests = cut.select("key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(laid, "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""Quality classifier by compression: one zstandard dictionary of good and one of bad labelled text.

A text is cut into blocks; each block is compressed with either dictionary. The differences of the compressed sizes,
normalised by the larger one, for two block sizes, and the plain compressibility of the whole text are calibrated to
a probability by a logistic model. Fitting takes bounded samples of rows (DOCS of each class for the dictionaries, DOCS
others for the calibration), of which it takes whole texts; scoring takes whole texts, in the task that reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteloom.llm.common import documents, fields_of, kept, row_of, table, text_of
from graniteloom.llm.fitting import fit_logistic, held_out, logistic, sample_ids

#: Most labelled rows of each class in each of the two samples; bytes of the pieces that the dictionaries' texts are cut
#: into (all of them are used).
DOCS, PIECE_BYTES = 3000, 2048
DICTIONARY_BYTES = 110 * 1024
BLOCKS = (512, 2048)
LEVEL = 3
SEED = 9


class Sizes:
    """Features of a text from its compressed sizes."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        made = [zstandard.ZstdCompressionDict(d) for d in (good, bad)]
        self.good, self.bad = (zstandard.ZstdCompressor(**plain, dict_data=m).compress for m in made)
        self.plain = zstandard.ZstdCompressor(**plain).compress

    def __call__(self, text: str) -> list[float]:
        raw = text.encode()
        out = []
        for block in BLOCKS:
            pieces = [raw[i : i + block] for i in range(0, len(raw), block)]
            good, bad = sum(len(self.good(p)) for p in pieces), sum(len(self.bad(p)) for p in pieces)
            out.append((bad - good) / max(good, bad, 1))
        # The plain ratio falls with length; what is left of it tells repeated text.
        return [*out, len(self.plain(raw)) / (len(raw) + 50), float(np.log1p(len(raw)))]


def dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary of the samples; too little text for the builder is a dictionary by its content."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = DOCS, seed: int = SEED) -> dict:
    """Dictionaries and calibration. labels: doc_id and label (0 bad, 1 good, null ignored) of the rows to learn from.

    A class whose texts are too few for zstandard's dictionary builder has its texts themselves as the dictionary. With
    no text of a class at all there is nothing to compare with: score() is then constant, (n1 + 1) / (n + 2).
    """
    # Half of the labelled rows, by hash, may build dictionaries, the other half calibrates.
    half = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2)) == 0
    text = docs.select(F.col("doc_id").alias("_id"), text_of().alias("_t"))
    body = text.join(F.broadcast(sample_ids(labels.where(half), label, rows, seed + 1)), "_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, text, value in zip(batch["_id"], batch["_t"], batch["_label"], strict=True):
                raw = text.encode()
                pieces = [raw[at : at + PIECE_BYTES] for at in range(0, len(raw), PIECE_BYTES)]
                yield pd.DataFrame({"id": int(i), "label": int(value), "piece": pieces})

    pieces = body.mapInPandas(cut, "id long, label int, piece binary").toPandas().sort_values(["label", "id", "piece"], kind="stable")
    made = [dictionary([bytes(p) for p in pieces.loc[pieces["label"] == value, "piece"]]) for value in (1, 0)]
    tuned = text.join(F.broadcast(sample_ids(labels.where(~half), label, rows, seed + 1)), "_id")
    good, bad = made
    if not good or not bad:
        rows = tuned.select("_label").toPandas()
        return {"good": good, "bad": bad, "model": fit_logistic(np.zeros((0, len(BLOCKS) + 2)), rows["_label"].to_numpy(dtype=float))}

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = Sizes(good, bad)
        for batch in batches:
            yield pd.DataFrame({"id": batch["_id"], "label": batch["_label"], "x": [sizes(t) for t in batch["_t"]]})

    found = tuned.mapInPandas(measured, "id long, label int, x array<double>").toPandas().sort_values("id", kind="stable")
    x = np.array(found["x"].tolist(), dtype=float).reshape(len(found), len(BLOCKS) + 2)
    return {"good": good, "bad": bad, "model": fit_logistic(x, found["label"].to_numpy(dtype=float))}


def score(docs: DataFrame, trained: dict, keep: list[str], *, text: str = "text") -> DataFrame:
    """keep and score (0 to 1, higher: good) of each row; a null text counts as empty. Rows are independent, so null and
    repeated ids do not matter; equal texts get equal scores, and an empty table gives an empty one. A column of keep
    named score gives way to the result."""
    stay = kept(keep, "score")
    body = docs.select(row_of(stay).alias("row"), text_of(text).alias("text"))
    schema = T.StructType([body.schema["row"], T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        sizes = Sizes(model["good"], model["bad"]) if model["good"] and model["bad"] else lambda _: [0.0] * (len(BLOCKS) + 2)
        for batch in batches:
            x = np.array([sizes(t.as_py()) for t in batch.column(1)], dtype=float).reshape(batch.num_rows, len(BLOCKS) + 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logistic(model["model"], x))], ["row", "score"])

    return body.mapInArrow(run, schema).select(*fields_of("row", stay), "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    apart = held_out("doc_id", 3, 1)
    trained = train(docs, table(spark, sf_dir, "labels").where(~apart))
    scored = score(docs, trained, ["doc_id"])
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

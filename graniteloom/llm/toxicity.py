"""Toxicity by maximum-scoring segments of token log-odds.

Tokens get log-odds of toxic against clean labelled text with informative Dirichlet priors: a token's prior is its
share of all labelled text. Tokens are counted in a fixed number of hash buckets, so what is sent to the tasks has a
bound whatever the vocabulary. A bucket whose log-odds are significant, toxic or clean, keeps them; all other tokens
share the log-odds of their pooled counts. Words without a significant bucket fall back on their stem (first letters),
so unseen forms of a known stem count. Every token's score is its log-odds less DRIFT: clean text must drift downwards
for its segments to end.

A linear-time scan (all maximal scoring segments) finds every toxic passage of a text. In clean text of m tokens,
K m exp(-lambda S) passages of a score of S or more are expected; lambda and K are fitted to the passages of clean
labelled texts. The evidence lambda S - ln(K m) of a text's passages is aggregated and calibrated to a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteloom.llm.common import documents, fields_of, kept, row_of, table, text_of, words_of, written
from graniteloom.llm.fitting import fit_logistic, held_out, logistic, sample_ids

#: Hash buckets of tokens; a significant one takes 8 bytes of what is broadcast, so 32 MB at most.
BUCKETS = 1 << 22
#: Least texts a token is in, least z-score and toxic log-odds, letters of the stems, weight of the prior, drift.
LEAST_TEXTS, LEAST_Z, LEAST_ODDS, STEMS, PRIOR, DRIFT = 3, 3.7, 1.0, (4, 5, 6, 7, 8), 10.0, 1.0
#: Most labelled rows of each class that calibrate; most bytes of labels (32 a row) that are broadcast: more of them are
#: joined by a shuffle.
DOCS, BROADCAST_BYTES = 4000, 32 << 20
SEED = 1
TOKEN = re.compile(r"[^\W\d_]+")
SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("score", T.DoubleType())]))
ARROW_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
#: Tokens whose scores a worker remembers.
REMEMBERED = 300_000


def bucket_counts(docs: DataFrame, labels: DataFrame, *, label: str = "toxic") -> DataFrame:
    """bucket, y1 and y0: toxic and clean labelled texts that hold a token of the bucket (words, and stems that begin
    with "~"), over all labelled rows.

    Texts of one label that share their least hash of three words, as copies and near copies mostly do, share one vote:
    each of n such texts counts 1/n. A row of bucket -1 holds the votes of all texts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label"))
    known = F.broadcast(known) if labels.count() * 32 <= BROADCAST_BYTES else known
    flat = F.lower(text_of())
    words = docs.select("doc_id", F.regexp_extract_all(flat, F.lit(r"\p{L}+"), F.lit(0)).alias("_w"), words_of(flat).alias("_s")).join(known, "doc_id")
    least = F.expr("coalesce(array_min(transform(_s, (w, i) -> xxhash64(w, get(_s, i + 1), get(_s, i + 2)))), 0)")
    body = written(words.select("_label", least.alias("_least"), F.array_distinct("_w").alias("_w")))
    # Groups of two or more are few; their votes meet the texts before these are cut into tokens, so that tokens are
    # summed in the tasks that read the texts.
    groups = written(body.groupBy("_label", "_least").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    voting = body.join(groups, ["_label", "_least"], "left").withColumn("_vote", 1 / F.coalesce("_n", F.lit(1)))
    stems = ", ".join(f"transform(filter(_w, w -> length(w) > {n}), w -> concat('~', left(w, {n})))" for n in STEMS)
    hashed = F.expr(f"array_distinct(transform(concat(array('~'), _w, {stems}), t -> CASE WHEN t = '~' THEN -1L ELSE pmod(xxhash64(t), {BUCKETS}L) END))")
    each = voting.select("_label", "_vote", F.explode(hashed).alias("bucket"))
    return each.groupBy("bucket").agg(*(F.sum(F.when(F.col("_label") == v, F.col("_vote")).otherwise(0.0)).alias(f"y{v}") for v in (1, 0)))


def lexicon(docs: DataFrame, labels: DataFrame, *, label: str = "toxic") -> dict:
    """buckets (sorted) and odds of the significant buckets, other (log-odds of all the rest), as arrays and a number."""
    counts = written(bucket_counts(docs, labels, label=label))
    totals = counts.where("bucket = -1").first()
    n1, n0 = (float(totals["y1"]), float(totals["y0"])) if totals else (0.0, 0.0)
    # The prior of a bucket is PRIOR texts of either class, with the bucket's rate in all labelled texts.
    prior = F.greatest((F.col("y1") + F.col("y0")) / max(1.0, n1 + n0) * PRIOR, F.lit(0.05))
    a, b = F.col("y1") + prior, F.col("y0") + prior
    odds = F.log(a / F.greatest(n1 + PRIOR - a, F.lit(0.5))) - F.log(b / F.greatest(n0 + PRIOR - b, F.lit(0.5)))
    scored = counts.where("bucket >= 0").select("bucket", "y1", "y0", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
    toxic = (F.col("y1") >= LEAST_TEXTS) & (F.col("z") >= LEAST_Z) & (F.col("odds") > LEAST_ODDS)
    clean = (F.col("y0") >= LEAST_TEXTS) & (F.col("z") <= -LEAST_Z)
    found = scored.where(toxic | clean).select("bucket", "odds").toPandas().sort_values("bucket")
    rest = scored.agg(*(F.coalesce(F.sum(F.when(toxic | clean, 0.0).otherwise(F.col(c))), F.lit(0.0)).alias(c) for c in ("y1", "y0")), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}s") for c in ("y1", "y0"))).first()
    other = float(np.log((rest["y1"] + 1) / (rest["y1s"] + 1)) - np.log((rest["y0"] + 1) / (rest["y0s"] + 1)))
    return {"buckets": found["bucket"].to_numpy(dtype=np.int32), "odds": found["odds"].to_numpy(dtype=np.float32), "other": other}


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) of a sequence of token scores, in linear time.

    Candidates lie on a stack, each with its sums before and up to it, and a link to the nearest earlier one of a lower
    sum before: a new positive token is joined to that one if the sum up to it is higher, and so on along the links.
    """
    sums = np.cumsum(scores, dtype=np.float64)
    at = np.flatnonzero(scores > 0)
    stack: list[tuple[int, int, float, float, int]] = []  # begin, end, sum before, sum up to its end, link
    for i, upto, own in zip(at.tolist(), sums[at].tolist(), scores[at].tolist(), strict=True):
        begin, left = i, upto - own
        k = len(stack) - 1
        while k >= 0 and stack[k][2] >= left:
            k = stack[k][4]
        while k >= 0 and stack[k][3] < upto:
            begin, left = stack[k][0], stack[k][2]
            link = stack[k][4]
            del stack[k:]
            k = link
        stack.append((begin, i + 1, left, upto, k))
    return [(b, e, upto - left) for b, e, left, upto, _ in stack]


class Passages:
    """Toxic passages of texts, from a lexicon. What it learns about tokens stays with the lexicon."""

    def __init__(self, lexicon: dict):
        import xxhash

        self.buckets, self.odds = lexicon["buckets"], lexicon["odds"]
        self.neutral = lexicon["other"] - DRIFT
        self.known: dict[str, float] = lexicon.setdefault("known", {})
        self.hash = xxhash.xxh64_intdigest
        marked = np.zeros(BUCKETS, dtype=np.uint8)
        marked[self.buckets] = 1
        self.marked = marked.tobytes()

    def significant(self, token: str) -> float | None:
        bucket = self.hash(token.encode(), seed=42) % BUCKETS
        return float(self.odds[np.searchsorted(self.buckets, bucket)]) if self.marked[bucket] else None

    def token(self, token: str) -> float:
        """The score of a token: by its own log-odds, else those of its longest stem that has any, else the others'."""
        odds = self.significant(token)
        for n in reversed(STEMS):
            if odds is None and len(token) > n:
                odds = self.significant("~" + token[:n])
        score = self.neutral if odds is None else odds - DRIFT
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[token] = score
        return score

    def find(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and the maximal segments as (first token, token after the last, score).

        Every occurrence of a token scores, so a passage is found wherever it stands and however often.
        """
        tokens = TOKEN.findall(text.lower())
        scores = list(map(self.known.get, tokens))
        if None in scores:
            scores = [self.token(t) if s is None else s for s, t in zip(scores, tokens, strict=True)]
        return len(tokens), maximal_segments(np.array(scores, dtype=np.float64))


def tail(scores: np.ndarray, tokens: float) -> tuple[float, float]:
    """lambda and K of clean passages: an exponential tail above the median score, by maximum likelihood. Too few
    passages (under 20) leave lambda at 1."""
    if len(scores) < 20:
        return 1.0, float((len(scores) + 0.5) / max(1.0, tokens))
    least = float(np.median(scores))
    beyond = scores[scores > least]
    rate = float(np.clip(1 / max(1e-9, float((beyond - least).mean()) if len(beyond) else 1.0), 0.1, 10.0))
    return rate, float((len(beyond) + 0.5) / max(1.0, tokens) * np.exp(rate * least))


def evidence(m: int, scores: list[float], rate: float, k: float) -> list[float]:
    """-ln(K m exp(-lambda S)) of the best passage of a text of m tokens, and the logarithm of the sum of those above 0."""
    each = [rate * s - float(np.log(k * max(m, 1))) for s in scores]
    return [max(each, default=-1.0), float(np.log1p(sum(e for e in each if e > 0)))]


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = DOCS, seed: int = SEED) -> dict:
    """Lexicon, tail (lambda and K) and calibration. labels: doc_id and label (0 clean, 1 toxic, null ignored) to learn
    from; without labels of both classes the score is constant."""
    words = lexicon(docs, labels, label=label)
    chosen = F.broadcast(sample_ids(labels, label, rows, seed))
    body = docs.select(F.col("doc_id").alias("_id"), text_of().alias("_t")).join(chosen, "_id")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passages = Passages(words)
        for batch in batches:
            seen = [passages.find(t) for t in batch["_t"]]
            yield pd.DataFrame({"id": batch["_id"], "label": batch["_label"], "m": [m for m, _ in seen], "s": [[s for _, _, s in f] for _, f in seen]})

    sample = body.mapInPandas(found, "id long, label int, m long, s array<double>").toPandas().sort_values("id", kind="stable")
    clean = sample[sample["label"] == 0]
    rate, k = tail(np.array([s for row in clean["s"] for s in row], dtype=float), float(clean["m"].sum()))
    x = np.array([evidence(m, s, rate, k) for m, s in zip(sample["m"], sample["s"], strict=True)], dtype=float).reshape(len(sample), 2)
    return {"words": words, "lambda": rate, "k": k, "model": fit_logistic(x, sample["label"].to_numpy(dtype=float))}


def score(docs: DataFrame, trained: dict, keep: list[str], *, text: str = "text") -> DataFrame:
    """keep, score (0 to 1, higher: toxic), n_passages (significant ones, E < 0.05) and passages of each row.

    passages are the significant ones by position: array<struct<first, stop, score>>, in tokens, stop exclusive.
    A null text counts as empty: it has no passage and the least evidence. Rows are independent, so null and repeated
    ids do not matter; equal texts get equal scores, and an empty table gives an empty one. A column of keep with the
    name of a result gives way to it.
    """
    made = ["score", "n_passages", "passages"]
    stay = kept(keep, *made)
    body = docs.select(row_of(stay).alias("row"), text_of(text).alias("text"))
    schema = T.StructType([body.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType()), T.StructField("passages", SPANS)])
    sent = docs.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        passages, rate, k = Passages(model["words"]), model["lambda"], model["k"]
        for batch in batches:
            x, n, spans = [], [], []
            for t in batch.column(1):
                m, found = passages.find(t.as_py())
                x.append(evidence(m, [s for _, _, s in found], rate, k))
                spans.append([{"first": b, "stop": e, "score": float(s)} for b, e, s in found if k * max(m, 1) * np.exp(-rate * s) < 0.05])
                n.append(len(spans[-1]))
            scores = logistic(model["model"], np.array(x, dtype=float).reshape(len(x), 2))
            columns = [batch.column(0), pa.array(scores), pa.array(n, pa.int64()), pa.array(spans, ARROW_SPANS)]
            yield pa.RecordBatch.from_arrays(columns, ["row", *made])

    return body.mapInArrow(run, schema).select(*fields_of("row", stay), *made)


def spelled(passages: Column) -> Column:
    return F.array_join(F.transform(passages, lambda p: F.concat_ws(":", p["first"].cast("string"), p["stop"].cast("string"))), ",")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the significant passages of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    apart = held_out("doc_id", 4, 2)
    trained = train(docs, table(spark, sf_dir, "labels").where(~apart))
    scored = score(docs, trained, ["doc_id"])
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages", spelled(F.col("passages")).alias("passages"))

import hashlib
import os

import corpus_pipeline
from graniteloom.llm import bpe, mixing, queries
from graniteloom.llm.common import documents, written
from graniteloom.llm.oracles import OP10
from graniteloom.operators.state import shared_dir
from tests.comparing import oracle
from tests.llm import brute
from tests.llm.test_llm import WORD, shingles


def test_every_operator_is_registered():
    names = [n.split("_")[0] for n in queries.queries()]
    assert names == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages_against_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    given = {r["doc_id"]: r for r in documents(spark, sf_dir).collect()}
    docs, results = documents(spark, sf_dir), []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir))
        results.append(docs.collect())
    rules, near, private, mix, tokens = results
    assert all(r.__fields__ == ["doc_id", "text", "lang", "source", "n_chars"] for stage in results[:4] for r in stage[:1])

    kept = oracle(OP10, sf_dir)
    assert sorted(r["doc_id"] for r in rules) == sorted(kept.loc[kept["kept"], "doc_id"])

    sets = {r["doc_id"]: shingles(r["text"]) for r in rules}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in near) == sorted({find(i) for i in sets})

    texts = [given[r["doc_id"]]["text"] for r in near]
    assert {r["doc_id"]: r["text"] for r in private} == {r["doc_id"]: brute.redacted(t, x) for r, t, x in zip(near, texts, brute.personal_data(texts), strict=True)}

    sizes = {r["doc_id"]: len(WORD.findall(r["text"])) for r in private}
    taken = {}
    for r in mix:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    want = {r["doc_id"]: r["taken"] for r in mixing.plan(spark.createDataFrame(private), ["doc_id"]).collect() if r["taken"]}
    assert taken == want and all(taken[i] <= 3 * sizes[i] for i in taken)

    library = Tokenizer.from_file(bpe.vocabulary_path())
    ids = [library.encode(r["text"], add_special_tokens=False).ids for r in mix]
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in tokens) == sorted((r["doc_id"], hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for r, i in zip(mix, ids, strict=True))


ODD = [
    (None, "a@b.cd " + "the word of an old house is near to you and it was there", "en", None, 1),
    (None, "a@b.cd " + "the word of an old house is near to you and it was there", "en", None, 1),
    (7, "the quick brown fox is on the lazy dog that was not there for you", "en", "s", 2),
    (7, "das ist nicht der Hund und auch nicht die Katze von dem Haus an der Ecke", "de", "s", 2),
    (8, None, "en", "s", 0),
    (9, "", None, "t", 0),
    (10, "the of and " * 40_000, "en", "t", 3),
    (11, " ".join(f"the{i} of and" for i in range(30_000)), "en", "t", 3),
]


def test_stages_with_odd_rows_and_none(spark, sf_dir):
    """Null and repeated ids, repeated rows, null, empty and very long texts, a further column, and an empty table."""
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long, at long")
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(r["at"] for r in stages["quality_rules"](spark, docs, sf_dir).collect()) == [0, 1, 2, 3, 11 - 4]
    kept = sorted(r["at"] for r in stages["near_copies"](spark, docs, sf_dir).collect())
    assert kept in ([0, 2, 3, 4, 5, 6, 7], [1, 2, 3, 4, 5, 6, 7])
    private = {r["at"]: r["text"] for r in stages["personal_data"](spark, docs, sf_dir).collect()}
    assert len(private) == 8 and private[0].startswith("[EMAIL] the") and private[4] is None and private[7] == ODD[7][1]
    mixed = stages["source_mix"](spark, docs, sf_dir)
    assert mixed.columns == docs.columns and {r["at"] for r in mixed.select("at").distinct().collect()} <= {0, 1, 2, 3, 6, 7}
    ids = stages["token_ids"](spark, docs, sf_dir).collect()
    assert len(ids) == 8 and sum(r["n_tokens"] == 0 for r in ids) == 2
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_one_table_is_left(spark, sf_dir):
    """After a run only what its result reads from is on the disk."""
    tables = lambda: set(os.listdir(f"{shared_dir(spark).removeprefix('file://')}/tables"))
    written(spark.range(1))
    before = tables()
    result = corpus_pipeline.run(spark, sf_dir)
    assert len(tables() - before) == 1 and before <= tables() and result.count() > 0

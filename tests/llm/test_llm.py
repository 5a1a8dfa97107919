import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graniteloom.llm import bpe, chat, components, embedding_dedup, mixing, ngram_join, pii, quality, rules, sharding, toxicity
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def words(n, seed, vocabulary=300):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


EDGE = [None, "", " \n\t ", "one", "two words", "One  TWO\x0bthree four", "é é é é é é", " ".join(words(30000, 9, 50)), "\\ # < : </turn> ###", "a b c d e f"]


# -- 1, 9: classifiers


def labelled(spark, n=240):
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        text = " ".join(words(40, i))
        if bad:
            text = " ".join(w + random.Random(i + j).choice(["$$$", "&&&", "###"]) for j, w in enumerate(text.split())) + f" vile{'abcdef'[i % 6]} nasty"
        rows.append((i, text, int(bad), int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")


def test_classifiers_hold_out(spark):
    rows = labelled(spark)
    train = rows.where("doc_id < 180").select("doc_id", "toxic", "quality")
    both = rows.select("doc_id", "text").unionByName(docs(spark, EDGE, 1000).select("doc_id", "text"))
    for module, label, args in ((toxicity, "toxic", {}), (quality, "quality", {"rows": 60})):
        out = {r["doc_id"]: r["score"] for r in module.score(both, module.train(both, train, **args), ["doc_id"]).collect()}
        assert len(out) == 250 and all(0 <= s <= 1 for s in out.values())
        hits = sum((out[r["doc_id"]] >= 0.5) == bool(r[label]) for r in rows.where("doc_id >= 180").collect())
        assert hits >= 57
        assert out[1000] == out[1001]


def test_classifiers_without_labels(spark):
    some = docs(spark, ["a b c", None])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for module in (toxicity, quality):
        out = module.score(some, module.train(some, none), ["doc_id"]).collect()
        assert len(out) == 2 and all(0 <= r["score"] <= 1 for r in out)
        assert module.score(some.limit(0), module.train(some.limit(0), none), ["doc_id"]).count() == 0


def test_maximal_segments_against_brute_force():
    """One by one: the best stretch (the shortest among equals), then those left and right of it."""
    r = random.Random(4)

    def split(scores, lo, hi):
        best = max(((sum(scores[i:j]), i - j, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return [*split(scores, lo, i), (i, j, best[0]), *split(scores, j, hi)]

    for _ in range(400):
        scores = [r.uniform(-2, 1.6) for _ in range(r.randrange(18))]
        got, want = toxicity.maximal_segments(np.array(scores)), split(scores, 0, len(scores))
        assert [(b, e) for b, e, _ in got] == [(b, e) for b, e, _ in want]
        assert [v for *_, v in got] == pytest.approx([v for *_, v in want])
    began = time.time()
    assert len(toxicity.maximal_segments(np.tile([1.0, -3.0], 300_000))) == 300_000 and time.time() - began < 10


def words_lexicon(odds):
    import xxhash

    rows = sorted((xxhash.xxh64_intdigest(t.encode(), seed=42) % toxicity.BUCKETS, v) for t, v in odds.items())
    return {"buckets": np.array([b for b, _ in rows], np.int32), "odds": np.array([v for _, v in rows], np.float32), "other": 0.0}


def test_every_toxic_passage_is_found(spark):
    words = words_lexicon({"vile": 5.0, "nasty": 4.0, "foul": 4.0, "kind": -3.0, "~grim": 2.5})
    passages = toxicity.Passages(words)
    assert [passages.token(t) for t in ("vile", "kind", "calm", "grimmest", "grim")] == [4.0, -4.0, -1.0, 1.5, -1.0]
    clean, toxic = " ".join(["calm"] * 30), "vile nasty foul"
    assert passages.find(f"{toxic} {clean} {toxic} {clean}")[1] == [(0, 3, 10.0), (33, 36, 10.0)]
    assert passages.find("vile kind vile")[1] == [(0, 1, 4.0), (2, 3, 4.0)] and passages.find("vile calm vile")[1] == [(0, 3, 7.0)]
    apart = " ".join(f"{w} {clean}" for w in toxic.split())
    assert max(s for *_, s in passages.find(f"{apart} {toxic}")[1]) >= 10.0
    model = {"words": words, "lambda": 1.0, "k": 0.001, "model": toxicity.train(docs(spark, ["a"]), spark.createDataFrame([], "doc_id long, toxic int"))["model"]}
    row = toxicity.score(docs(spark, [f"{toxic} {clean} {toxic}"]), model, ["doc_id"]).first()
    assert row["n_passages"] == 2 and [(p["first"], p["stop"]) for p in row["passages"]] == [(0, 3), (33, 36)]


def test_lexicon_against_brute_force(spark):
    """Counts with one vote a group of copies, log-odds, and the same buckets in tasks as in the lexicon."""
    import xxhash

    r = random.Random(3)
    texts = [" ".join(r.choice(["calm", "kind", "grün", "walking", "walked"] + ["vile", "nastiest", "nasty"] * (i % 3 == 0)) for _ in range(12)) for i in range(240)] + ["vile kind calm"] * 50
    labels = [(i, int(i % 3 == 0) if i < 240 else 0) for i in range(290)]
    rows, known = docs(spark, texts), spark.createDataFrame([*labels, (None, 1), (9999, 1)], "doc_id long, toxic int")
    seen, groups = {}, {}
    for (i, label), t in zip(labels, texts, strict=True):
        w = t.split()
        three = {tuple(w[j : j + 3]) for j in range(len(w))}
        key = min(three, key=lambda x: spark_hash(x))
        groups.setdefault((label, key), []).append(i)
        seen[i] = {b for t in {*w, *("~" + x[:n] for x in w for n in toxicity.STEMS if len(x) > n)} for b in [xxhash.xxh64_intdigest(t.encode(), seed=42) % toxicity.BUCKETS]}
    y = {}
    for (label, _), ids in groups.items():
        for i in ids:
            for b in [-1, *seen[i]]:
                y.setdefault(b, [0.0, 0.0])[label] += 1 / len(ids)
    got = {x["bucket"]: (x["y0"], x["y1"]) for x in toxicity.bucket_counts(rows, known).collect()}
    assert set(got) == set(y) and all(got[b] == pytest.approx(y[b]) for b in y)
    found = toxicity.lexicon(rows, known)
    n0, n1 = y[-1]
    for b, odds in zip(found["buckets"].tolist(), found["odds"].tolist(), strict=True):
        prior = max((y[b][0] + y[b][1]) / (n0 + n1) * toxicity.PRIOR, 0.05)
        a1, a0 = y[b][1] + prior, y[b][0] + prior
        assert odds == pytest.approx(np.log(a1 / max(n1 + toxicity.PRIOR - a1, 0.5)) - np.log(a0 / max(n0 + toxicity.PRIOR - a0, 0.5)), rel=1e-4)
    assert {xxhash.xxh64_intdigest(t.encode(), seed=42) % toxicity.BUCKETS for t in ("vile", "nasty", "~nast")} <= set(found["buckets"].tolist())


def spark_hash(three):
    """xxhash64 of up to three strings as Spark chains it."""
    import xxhash

    seed = 42
    for t in three:
        seed = xxhash.xxh64_intdigest(t.encode(), seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def test_tail_is_that_of_an_exponential():
    rng = np.random.default_rng(1)
    rate, k = toxicity.tail(rng.exponential(1 / 0.7, 20_000), 1e6)
    assert rate == pytest.approx(0.7, rel=0.05) and k == pytest.approx(0.02, rel=0.1)
    assert toxicity.tail(np.array([1.0]), 100.0)[0] == 1.0


def test_classifiers_with_odd_rows(spark):
    """Null and repeated ids, columns named like results, very long texts."""
    rows = spark.createDataFrame([(None, "vile", 1.0), (3, "vile", 2.0), (3, "calm " * 40_000, 3.0), (4, None, 4.0)], "doc_id long, text string, score double")
    train = labelled(spark)
    for module in (toxicity, quality):
        trained = module.train(train.select("doc_id", "text"), train.select("doc_id", "toxic", "quality"), **({"rows": 60} if module is quality else {}))
        out = module.score(rows, trained, ["doc_id", "score"])
        assert out.columns.count("score") == 1 and out.count() == 4 and all(0 <= r["score"] <= 1 for r in out.collect())


def test_dictionaries_carry_the_quality_score(spark):
    """Without its two dictionary features the model tells much less."""
    rows = labelled(spark, 400)
    trained = quality.train(rows.select("doc_id", "text"), rows.where("doc_id < 300").select("doc_id", "quality"), rows=100)
    sizes = quality.Sizes(trained["good"], trained["bad"])
    held = rows.where("doc_id >= 300").collect()
    x, y = np.array([sizes(r["text"]) for r in held]), np.array([r["quality"] for r in held])

    def auc(v):
        return np.mean([(a > b) + (a == b) / 2 for a in v[y == 1] for b in v[y == 0]])

    assert min(auc(x[:, 0]), auc(x[:, 1])) > 0.9
    assert quality.dictionary([b"short"]) == b"short" and quality.dictionary([]) == b""


# -- 2: personal data


def base(text):
    return brute.spelled(brute.base_spans(text))


def spans(spark, texts):
    out = {x["doc_id"]: x for x in pii.detect(docs(spark, texts), ["doc_id"]).select("doc_id", pii.spelled(F.col("base")).alias("base"), pii.spelled(F.col("spans")).alias("spans")).collect()}
    assert len(out) == len(texts)
    return [out[i]["base"] for i in range(len(texts))], [out[i]["spans"] for i in range(len(texts))]


def test_personal_data_base_and_context(spark):
    r = random.Random(2)
    noise = ["".join(r.choice("a1 .@-+()9é😀\n") for _ in range(r.randrange(60))) for _ in range(300)]
    known = [f"{' '.join(words(8, i))} call me at +1 (555) 555-{1000 + i} now" for i in range(20)]
    unseen = ["please call me at 5551239 now", "order 5559999 left"]
    texts = [*noise, *EDGE, "x@y.zz a@b.c.d_e@f.g 1.2.3.4 300.1.1.1 4539-1488-0343-6467 " + "1" * 5000 + " " + "a" * 5000 + "@", *known, *unseen]
    got, found = spans(spark, texts)
    assert got == [base(t) for t in texts]
    want = brute.personal_data(texts)
    assert found == [brute.spelled(x) for x in want]
    n = len(texts)
    assert found[n - 2] == "phone:18:25" and found[n - 1] == ""
    red = {x["doc_id"]: x for x in pii.redacted(docs(spark, texts)).collect()}
    assert [red[i]["text"] for i in range(n)] == [t if t is None else brute.redacted(t, x) for t, x in zip(texts, want, strict=True)]
    assert red[n - 2]["text"] == "please call me at [PHONE] now" and red[n - 2]["n_chars"] == 29 and len(red) == n
    assert pii.detect(docs(spark, ["x"]).limit(0), ["doc_id"]).count() == 0


def test_found_tokens_seed_further_patterns(spark):
    """Base phones carry one context to X, Y and Z; only these carry the next one to W."""
    near = [f"{' '.join(words(8, i))} call me at +1 (555) 555-{1000 + i} now" for i in range(20)]
    near += [f"{' '.join(words(8, 50 + i))} call me at 555100{i} now" for i in range(3)]
    far = [f"{' '.join(words(8, 70 + i))} his desk extension 555100{i} today" for i in range(3)]
    texts = [*near, *far, "the desk extension 5558888 today", "order 5559999 left"]
    found = spans(spark, texts)[1]
    assert found == [brute.spelled(x) for x in brute.personal_data(texts)]
    assert found[-2] == "phone:19:26" and found[-1] == ""


def test_bootstrapping_against_brute_force(spark):
    """Contexts, identifiers of several kinds and noise at random; most patterns end near a threshold."""
    r = random.Random(12)
    cues = ["call me at", "my badge is", "write to:", "the host", "token =", "see page"]
    values = [*(f"+1 (555) 555-{1000 + i}" for i in range(9)), *(f"u{i}@mail.example.org" for i in range(9)), *(f"10.0.{i}.1" for i in range(9)), *(f"55510{i}" for i in range(9))]
    values += [*(f'"{hex(r.getrandbits(160))[2:]}"' for _ in range(6)), "user_name", "jane.doe", "a.b.c.d", "q:r", "x" * 90 + "7", "word", "plain", "(12345),", "9" * 4]
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(r.randrange(1, 6)):
            parts += words(r.randrange(4), r.random(), 12)
            cue = r.choice(cues)
            parts.append(cue)
            parts.append(r.choice(values if r.random() < 0.8 else ["nothing", "home"]))
        texts.append(r.choice([" ", "  ", "\n"]).join(parts))
    texts += [*EDGE, "now.now", *texts[:30]]
    got, found = spans(spark, texts)
    want = [brute.spelled(x) for x in brute.personal_data(texts)]
    assert found == want and sum(a != b for a, b in zip(got, found, strict=True)) > 20


def test_a_text_of_100000_addresses(spark):
    text = " ".join(f"10.0.{i % 256}.1" for i in range(100_000))
    began = time.time()
    row = pii.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["text"] == " ".join(["[IP]"] * 100_000) and time.time() - began < 120


def test_personal_data_of_odd_rows(spark):
    """Null and repeated ids, columns named like results, and a table without rows."""
    rows = spark.createDataFrame([(None, "a@b.cd", "x", 1), (None, "a@b.cd", "x", 1), (1, None, "y", 2), (1, "z 1.2.3.4", None, 3)], "doc_id long, text string, base string, at int")
    got = pii.detect(rows, ["doc_id", "base", "at"])
    assert got.columns == ["doc_id", "at", "base", "spans"]
    assert sorted((str(r["doc_id"]), r["at"], len(r["base"])) for r in got.collect()) == [("1", 2, 0), ("1", 3, 1), ("None", 1, 1), ("None", 1, 1)]
    red = pii.redacted(rows)
    assert red.columns == rows.columns and sorted(str(r["text"]) for r in red.collect()) == ["None", "[EMAIL]", "[EMAIL]", "z [IP]"]


def test_addresses_with_parts_of_zero(spark):
    texts = ["10.0.0.1", "0.0.0.0", "1.2.3.00", "at 127.0.0.1, 192.168.0.1 and 010.000.255.0", "0.0.0.256", "1.0.0300.1", "0" * 3000 + ".0.0." + "0" * 3000, "0" * 3000 + ".0.0.x"]
    out = spans(spark, texts)[0]
    assert out == [base(t) for t in texts]
    assert out[0] == "ip:0:8" and out[1] == "ip:0:7" and out[2] == "ip:0:8" and out[3].count("ip:") == 3 and out[4] == out[5] == ""


# -- 3: embeddings


def reachable(n, pairs):
    """The smallest number that each of 0 to n - 1 reaches over the pairs."""
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def cosine_links(x):
    """Linked pairs of rows with vectors of one length; odd vectors link with nothing."""
    by = {}
    for i, v in enumerate(x):
        v = np.array([np.nan if c is None else c for c in v], float) if v is not None else np.zeros(0)
        if len(v) and np.isfinite(v).all() and v.any():
            by.setdefault(len(v), []).append((i, v / np.linalg.norm(v)))
    out = []
    for rows in by.values():
        u = np.stack([v for _, v in rows])
        a, b = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
        out += [(rows[i][0], rows[j][0]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    return out


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 8))
    x = np.concatenate([x, x[:60] + 0.1 * rng.standard_normal((60, 8)), x[:20] * 3.0, np.repeat(x[:1], 30, 0)])
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [None] * 8, [float("inf")] + [1.0] * 7]
    other = rng.standard_normal((300, 3)).tolist() + [[1.0, 2.0], [1.0, 2.0], [1.0, 2.1], [5.0], [7.5], [-1.0]]
    every = [list(map(float, v)) for v in x] + odd + other
    rows = [(i, v, "k") for i, v in enumerate(every)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")).collect()}
    pairs = cosine_links(every)
    counts = np.bincount(np.array(pairs).ravel(), minlength=len(every))
    assert len(got) == len(every) and all(got[i]["n_links"] <= counts[i] for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * counts.sum() and len(pairs) > 1000
    n = len(every)
    assert [got[i]["n_links"] for i in range(n - 6, n)] == [2, 2, 2, 1, 1, 0]
    assert all(got[len(x) + i]["n_links"] == 0 and got[len(x) + i]["kept"] for i in range(len(odd)))
    if sum(r["n_links"] for r in got.values()) == counts.sum():
        assert [got[i]["component_id"] for i in range(n)] == reachable(n, pairs)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_embeddings(spark):
    """Groups that lie apart are found whole, so components and counts are exact."""
    rng = np.random.default_rng(5)
    hubs = rng.standard_normal((40, 24))
    every = [list(map(float, hubs[i % 40] + 0.05 * rng.standard_normal(24))) for i in range(700)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([(3 * i, v) for i, v in enumerate(every)], "vec_id long, embedding array<double>")).collect()}
    pairs = cosine_links(every)
    counts, first = np.bincount(np.array(pairs).ravel(), minlength=len(every)), reachable(len(every), pairs)
    assert [(got[3 * i]["n_links"], got[3 * i]["component_id"]) for i in range(len(every))] == [(counts[i], 3 * first[i]) for i in range(len(every))]


def test_embeddings_of_odd_ids(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [0.0, 1.0]), (9, [0.0, 1.0]), (5, [1.0, 0.01])]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got[:2] == [("5", 1, "5", True), ("7", 1, "5", False)] and got[-2:] == [("None", 0, "None", True)] * 2


def test_traversal_visits_cells_in_order():
    x = np.random.default_rng(2).standard_normal((600, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embedding_dedup.fit(x, codewords=9)
    half, (a, b) = index["half"], index["books"]
    sums = embedding_dedup.region_distances(x[:, :half], a)[:, :, None] + embedding_dedup.region_distances(x[:, half:], b)[:, None, :]
    row, cell = embedding_dedup.visits(x, index)
    for i in range(len(x)):
        mine, flat = cell[row == i], sums[i].ravel()
        assert sorted(mine) == np.flatnonzero(flat <= index["reach"]).tolist() and (np.diff(flat[mine]) >= 0).all()


def test_reach_is_that_of_the_stated_recall():
    x = np.random.default_rng(1).standard_normal((2000, 16))
    assert embedding_dedup.fit(x, codewords=8)["reach"] == embedding_dedup.fit(x, recall=0.998, codewords=8)["reach"] > embedding_dedup.fit(x, recall=0.97, codewords=8)["reach"]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 1)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges[:-1]:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x["id"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in got} and 1060 in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 4, 5: mixing and sharding


def test_mix_and_shards(spark):
    rows = docs(spark, [*EDGE, *(" ".join(words(20 + i % 40, i)) for i in range(400))])
    plan = mixing.plan(rows, ["doc_id"]).collect()
    for r in plan:
        assert 0 <= r["taken"] <= 3 * r["size"]
    by = {}
    for r in plan:
        by.setdefault(r["target"], []).append(r)
    for target, rs in by.items():
        assert abs(sum(r["taken"] for r in rs) - target) <= 0.01 * target + 60
    assert sum(by) == pytest.approx(sum(r["size"] for r in plan), rel=1e-6)
    again = {r["doc_id"]: r["taken"] for r in mixing.plan(rows, ["doc_id"]).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in plan}
    mixed = mixing.mixed(rows).select("doc_id", mixing.word_count(F.col("text")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    assert {r["doc_id"]: r["n"] for r in mixed.collect()} == {i: t for i, t in again.items() if t}
    assert mixing.plan(rows.limit(0), ["doc_id"]).count() == 0



def test_mix_against_brute_force(spark):
    """Targets, seats of sources and of shards, and the runs of words in them."""
    rows = docs(spark, [*EDGE[:7], *(" ".join(words(20 + i % 40, i)) for i in range(300))])
    got = {r["doc_id"]: r for r in mixing.plan(rows, ["doc_id"], shards=8, blocks=500).collect()}
    given = [(r["doc_id"], r["source"], r["text"] or "") for r in rows.collect()]
    size = {i: len(WORD.findall(t)) for i, _, t in given}
    names = sorted({s for _, s, _ in given}, key=lambda s: (s is None, s or ""))
    sums = {s: sum(size[i] for i, x, _ in given if x == s) for s in names}
    share = brute.targets(sums, mixing.WEIGHTS, 3)
    assert all(r["target"] == pytest.approx(float(share[r_source])) and r["source_size"] == sums[r_source] for i, r_source, _ in given for r in [got[i]])
    total = sum(sums.values())
    block = max(1, total // 500)
    seats = brute.sainte_lague({s: float(share[s]) for s in names}, total // block)

    def place(*parts):
        return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:15], 16)

    for s in names:
        most = 3 * sums[s]
        take = most if share[s] >= most else min(seats[s] * block, most)
        passes, left = divmod(take, sums[s]) if sums[s] else (0, 0)
        cells = {}
        for i, x, t in given:
            if x == s:
                at = place("20", str(i))
                cells.setdefault(at % 8, []).append((at, hashlib.md5(t.encode()).hexdigest(), i))
        cells = dict(sorted(cells.items()))
        load = {c: sum(size[i] for *_, i in m) for c, m in cells.items()}
        quota = brute.sainte_lague({c: float(v) for c, v in load.items()}, int(left / block + 0.5))
        for c, members in cells.items():
            run = [i for *_, i in sorted(members) for _ in range(size[i])]
            begin = place("21", "null" if s is None else "source", s or "", str(c)) % max(1, load[c] // block) * block
            part = (run * 2)[begin : begin + min(quota[c] * block, load[c])]
            for *_, i in members:
                assert got[i]["taken"] == passes * size[i] + part.count(i)


def test_rows_without_ids_are_mixed_and_kept(spark):
    """Null and repeated ids: no row is lost or met twice; columns may have any name."""
    texts = [(None, "a b c d e f g h"), (None, "k l m n o p q r s"), (1, "a b c d e f g h"), (1, "t u v w x y z"), (2, None)]
    rows = spark.createDataFrame([(i, t, "s", 7, 1.5) for i, t in texts], "doc_id long, text string, source string, at int, size double")
    taken = {r["row"]: r["taken"] for r in mixing.plan(rows.withColumn("row", F.coalesce("text", F.lit("")).substr(1, 1)), ["row", "size"]).collect() if r["row"] != "a"}
    out = mixing.mixed(rows)
    assert out.columns == rows.columns
    said = [r["text"] for r in out.collect()]
    assert sum(len(t.split()) for t in said) == sum(r["taken"] for r in mixing.plan(rows, ["doc_id"]).collect()) == 32
    assert sum(len(t.split()) for t in said if t.startswith("k")) == taken["k"]
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in ngram_join.one_of_each(rows).collect())
    assert kept == [("1", "a b c d e f g h"), ("1", "t u v w x y z"), ("2", ""), ("None", "k l m n o p q r s")]
    joined = ngram_join.near_copies(rows).collect()
    assert len(joined) == 5 and all(r["component_id"] is None for r in joined if r["doc_id"] is None)
    assert mixing.mixed(rows.limit(0)).count() == ngram_join.one_of_each(rows.limit(0)).count() == 0


def ring(keys, shards, per_shard=64):
    """The shard of each hashed key on a ring of shards with equal rooms, walked clockwise."""
    nodes = sorted((int.from_bytes(hashlib.sha256(f"{s}/{c}".encode()).digest()[:8], "big") >> 50, s) for s in range(shards) for c in range(per_shard))
    room = [len(keys) * (s + 1) // shards - len(keys) * s // shards for s in range(shards)]
    out = {}
    for cell, key in sorted(keys):
        at = next((i for i, (c, _) in enumerate(nodes) if c >= cell), 0)
        while room[nodes[at % len(nodes)][1]] == 0:
            at += 1
        out[key] = nodes[at % len(nodes)][1]
        room[out[key]] -= 1
    return out


def test_shards_against_a_ring_by_hand(spark):
    rows = spark.range(3000).select(F.col("id"), F.xxhash64("id").alias("h"), F.lit(17).alias("size"), F.xxhash64("id").alias("shard"))
    for n in (7, 40):
        out = sharding.shard_rows(rows, "id", "size", n, tie=["size"])
        assert out.columns == ["id", "h", "size", "shard", "slot"]
        got = {r["id"]: (r["shard"], r["slot"]) for r in out.collect()}
        hashes = {r["id"]: r["h"] % (1 << 64) >> 50 for r in rows.collect()}
        ties = {r["id"]: (r["t"] % 16, r["t"]) for r in rows.select("id", F.xxhash64("id", "size").alias("t")).collect()}
        want = ring([(hashes[i], (ties[i], i)) for i in hashes], n)
        assert {i: s for i, (s, _) in got.items()} == {i: s for (_, i), s in want.items()}


def test_shards_are_even_and_move_little(spark):
    """Both laws, with null and repeated keys a third of the rows; a shard more moves few keys."""
    base = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("t "), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int"))).alias("text"), F.col("id").alias("slot"))
    for law in sharding.LAWS:
        out = sharding.shard_documents(base, 13, law).toPandas()
        assert len(out) == 30_000 and all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard")["slot"])
        load = out.groupby("shard")["size"].agg("count" if law == "rows" else "sum")
        assert len(load) == 13 and load.max() - load.min() <= (1 if law == "rows" else 2 * 120)
    keys = spark.range(50_000).select("id", F.lit(1).alias("size"))
    one, two = (sharding.shard_rows(keys, "id", "size", n).select("id", "shard").toPandas().set_index("id")["shard"] for n in (40, 41))
    moved = float((one != two.loc[one.index]).mean())
    assert 1 / 41 <= moved < 0.08
    assert sharding.shard_documents(base.limit(0), 7).count() == 0


# -- 6: n-gram join


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_join_against_brute_force(spark):
    r = random.Random(6)
    texts = [*EDGE]
    passage = words(30, 77)
    for family in range(25):
        one = words(r.choice([4, 6, 20, 60, 150]), family, 4000) + (passage if family % 2 else [])
        for _ in range(r.choice([1, 2, 3, 12])):
            w = [*one]
            for _ in range(r.randrange(0, 1 + len(w) // 40)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += texts[10:30] + [" ".join(words(150, 5, 4000)[: 150 - k]) for k in range(0, 60, 2)]
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.near_copies(docs(spark, texts)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert ngram_join.one_of_each(docs(spark, texts)).count() == len({find(i) for i in range(len(texts))})
    assert ngram_join.near_copies(docs(spark, ["x"]).limit(0)).count() == 0


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 4)
    one = words(60, 1, 4000)
    texts = [" ".join([*one[:k], f"y{k}", *one[k + 1 :]]) for k in range(40)] + [" ".join(one[:40] + words(3, k, 10**6)) for k in range(12)]
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.near_copies(docs(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


# -- 7: chat


def test_chat_windows(spark):
    r = random.Random(7)
    rows = []
    for c in range(30):
        for t in range(r.randrange(1, 12)):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, r.choice(EDGE[:7] + EDGE[8:]) if t % 4 == 0 else " ".join(words(r.randrange(1, 90), c * 50 + t)), "x"))
    rows += [(99, t, "assistant", f"turn {t} \\h<", "x") for t in range(2500)] + [(98, 7 * t, "system" if t == 0 else "user", f"turn {t}", "x") for t in range(1300)] + [(None, 0, None, None, "x"), (50, None, "user", "a", "x"), (50, None, "user", "a", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    out = chat.windows(frame, budget=200, history=60)
    assert all(x["tokens"] <= 200 or x["over_budget"] for x in out.collect())
    got = {}
    for x in chat.read_back(out).orderBy("conv_id", "part", "window").collect():
        a, b = got.setdefault(x["conv_id"], ([], []))
        a += [(t["role"], t["text"]) for t in x["turns"]]
        b.append(x["loss"])
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda x: (str(x[0]), -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: a for c, (a, _) in got.items()} == want
    assert all("".join(b) == "".join(t for role, t in want[c] if role == "assistant") for c, (_, b) in got.items())
    assert chat.windows(frame.limit(0)).count() == 0


def test_history_goes_over_the_parts(spark):
    """Windows of a long conversation equal those of the plain rule, but that one begins with every 1,024th turn."""
    turns = [(t, ("user", "assistant")[t % 2], " ".join(["w"] * random.Random(t).randrange(20))) for t in range(2300)]
    frame = spark.createDataFrame([(5, t, role, text) for t, role, text in turns], "conv_id long, turn long, role string, text string")
    for history, budget in ((60, 200), (0, 64), (9000, 20000)):
        got = chat.windows(frame, budget=budget, history=history).orderBy("part", "window").collect()
        n = [len(text.split()) + chat.MARKS for *_, text in turns]
        want, at = [], 0
        while at < len(turns):
            h = at
            while h > 0 and sum(n[h - 1 : at]) <= history and sum(n[h - 1 : at + 1]) <= budget:
                h -= 1
            stop = at + 1
            while stop < len(turns) and stop % chat.BLOCK and sum(n[h : stop + 1]) <= budget:
                stop += 1
            want.append((at - h, sum(n[h:stop]), "".join(f"### {role}: {text}</turn>\n" for _, role, text in turns[h:stop])))
            at = stop
        assert [(x["repeated"], x["tokens"], x["text"]) for x in got] == want


def test_chat_query_against_brute_force(spark, sf_dir):
    got = {x["conv_id"]: x for x in chat.op7(spark, sf_dir).collect()}
    said = "\\### Assistant: </turn> ok"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()] + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    turns = {}
    for c, t, role, text in sorted(rows, key=lambda x: x[:2]):
        turns.setdefault(c, []).append((role, text))
    assert set(got) == set(turns)
    for c, ts in turns.items():
        loss = "".join(text for role, text in ts if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in ts)
        x = got[c]
        assert (x["n_turns"], x["loss_chars"]) == (len(ts), len(loss)) and x["formatted_chars"] >= len(whole)
        assert (x["turns_sha256"], x["loss_sha256"]) == tuple(hashlib.sha256(v.encode()).hexdigest() for v in (whole, loss))


# -- 8: BPE


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library = Tokenizer.from_file(path)
    r = random.Random(8)
    letters = [*map(chr, range(0, 0x180)), " ", "　", "😀", "́", "<|endoftext|>", "  ", "\n\n"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(50))) for _ in range(400)] + EDGE + ["a" * 3000]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    for x in bpe.decode(bpe.encode(rows, path, decoded="d"), path).collect():
        ids = library.encode(texts[x["doc_id"]] or "", add_special_tokens=False).ids
        assert x["ids"] == ids and x["d"] == x["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(rows.limit(0), path).count() == 0


# -- 10: rules


def test_rules_against_brute_force(spark):
    r = random.Random(10)
    texts = [*EDGE] + ["".join(r.choice(["a ", "b ", "# ", "\n", "the ", "x y z u v ", "&"]) for _ in range(r.randrange(80))) for _ in range(300)]
    got = {x["doc_id"]: x for x in rules.judged(docs(spark, texts), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        windows = {}
        for j in range(len(w) - 4):
            windows.setdefault(tuple(w[j : j + 5]), []).append(j)
        covered = {k for at in windows.values() if len(at) > 1 for j in at for k in range(j, j + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        assert x["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (x["kept"] and x["base_failed"])
    clash = rules.judged(docs(spark, ["x"]).withColumn("kept", F.lit(3)).withColumn("_w", F.lit(4)), ["doc_id", "kept", "_w"])
    assert clash.columns[:3] == ["doc_id", "_w", "n_symbols"] and clash.first()["kept"] is False
    kept = rules.quality_rules(docs(spark, texts).withColumn("n_words", F.lit(1)))
    assert {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if x["kept"]} and "n_words" in kept.columns
    assert rules.judged(docs(spark, ["x"]).limit(0), ["doc_id"]).count() == 0


# -- written tables


def test_scratch_keeps_what_is_named(spark):
    import os

    from graniteloom.llm.common import Scratch, forget, written

    def there(df):
        return os.path.exists(df._written_path.removeprefix("file:").removeprefix("//"))

    with Scratch(spark) as outer:
        with Scratch(spark) as inner:
            gone, stays = written(spark.range(3)), inner.keep(spark.range(4))
        assert not there(gone) and there(stays) and stays.count() == 4
        other = written(spark.range(2))
        forget(other)
        assert not there(other)
    assert not there(stays) and outer.paths

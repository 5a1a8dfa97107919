r"""Personal data by bootstrapped contextual extraction, in DataFrame operations alone.

Base spans come from fixed patterns for e-mail addresses, IP addresses, card and phone numbers. They are the first
seeds; key-like tokens (long runs of letters and digits) are seeds of a fifth kind, `key`, which count as found only
where a context confirms them. Every seed, and every other identifier-like token, votes for the lexical patterns it
stands in: the two words before it, and the words before and after it.

A pattern is scored against all its places in the corpus: F is its number of distinct known values, P the number of
its distinct places that hold one, T the number of all its distinct places. It is confident if F is at least
LEAST_SEEDS and P at least half of T, and weighs log2(F + 1). A place is the three words from the slot on, so copies
of a document count once. Tokens that confident patterns extract join the known values, all patterns are scored anew,
and so on for a few rounds over the bipartite graph of patterns and values; all occurrences of what is found become
spans. The graph holds identifiers only, so it is small beside the corpus; counting T is the one pass over all words,
against the patterns that could come to enough values in some round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteloom.llm.common import Scratch, documents, fields_of, kept, let, row_of, running, text_of, words_of, written

#: Fixed values, in the order that settles ties. Possessive quantifiers and the anchors `(?:\G|(?<!...))` only keep
#: matching linear: they find the same spans as the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: The zeros before a part are not possessive: the last of them may be the part itself.
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What must stand in a text that holds the kind.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Identifier-like tokens: words with a digit, or with one of the signs @ _ : = + . between letters, of at least
#: LEAST_CHARS characters from their first to their last letter or digit. Length has no upper limit.
LIKE = r"[0-9]|\p{L}[@_:=+.]\p{L}"
LEAST_CHARS = 5
#: Other words (group 1), and the next word that may be like that (group 2); each search goes on where the last ended.
NEXT_CANDIDATE = r"\G((?:(?:[^\s0-9@_:=+.]++|(?<!\p{L})[@_:=+.]|[@_:=+.](?!\p{L}))*+\s++)*+)(\S++)"
#: Key-like tokens: twenty or more letters and digits, with four digits and a letter at least.
KEY = "^(?=(?:[A-Za-z]*[0-9]){4})(?=[0-9]*[A-Za-z])[A-Za-z0-9]{20,}$"

#: Least distinct known values of a pattern, least share of its places, rounds, and least mean weight of an instance.
LEAST_SEEDS, LEAST_SHARE, ROUNDS, LEAST_WEIGHT = 3, 0.5, 3, 2.0
#: Parts of the texts (one in so many) whose places are counted first, to drop hopeless patterns; all texts at last.
STAGES = (64, 8, 1)
#: Most bytes of patterns that are broadcast (16 a pattern); more of them meet the words by a shuffled join.
BROADCAST_BYTES = 16 << 20
#: Characters of the pieces that a text is cut into before spans are cut out of it.
PIECE = 4096

SPANS = "array<struct<start:int,stop:int,kind:string,value:string,first:int,last:int>>"
NO_SPANS = f"cast(array() AS {SPANS})"


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        digits = F.translate(m, " -", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)


def _word_ends(text: Column) -> Column:
    """Words of a piece of text that end inside it."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D][\x20\x09-\x0D]"))


def spans_of(cut: Column, kind: str, valid: Callable[[Column], Column]) -> Column:
    """The valid ones of the matches m in a text with the gaps g before each of them, as SPANS: code points
    [start, stop), and first and last, the numbers of the words they begin and end in. Matches must begin and end with
    a character of a word.

    Both follow from running sums over matches and gaps, so a text costs n log n in its matches.
    """

    def gap(s: Column, i: Column) -> Column:
        # A mark stands for the match before the gap, whose last word may end there.
        return F.concat(F.when(i == 0, "").otherwise("x"), F.get(s["g"], i))

    def sums(s: Column) -> Column:
        chars = F.transform(s["m"], lambda x, i: F.length(x) + F.length(F.get(s["g"], i)))
        words = F.transform(s["m"], lambda x, i: _word_ends(x) + _word_ends(gap(s, i)))
        return F.struct(s["m"].alias("m"), running(chars).alias("stop"), running(words).alias("last"))

    def made(s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            stop, last = F.get(s["stop"], i), F.get(s["last"], i)
            return F.struct(
                (stop - F.length(x)).alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), x.alias("value"), (last - _word_ends(x)).alias("first"), last.alias("last")
            )

        return F.filter(F.transform(s["m"], one), lambda z: valid(z["value"]))

    return let(let(cut, sums), made)


def _matches(text: Column, pattern: str) -> Column:
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))


def _bare(s: Column) -> Column:
    """A candidate without the signs around its letters and digits."""
    value = F.regexp_extract(s["value"], r"[\p{L}0-9](?s:.*)[\p{L}0-9]", 0)
    start = s["start"] + F.length(F.regexp_extract(s["value"], r"^[^\p{L}0-9]*", 0))
    kind = F.when(value.rlike(KEY), "key").otherwise("other")
    return F.struct(start.alias("start"), (start + F.length(value)).alias("stop"), kind.alias("kind"), value.alias("value"), s["first"].alias("first"), s["last"].alias("last"))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*(F.lit(k) for k in (*KINDS, "key"))), kind)


def _ordered(spans: Column) -> Column:
    """(start, stop, kind, value) by start, then kind as listed, then stop; repeated spans once."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("r"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value")))
    once = let(F.array_sort(keyed), lambda a: F.filter(a, lambda s, i: (i == 0) | (s != F.get(a, i - 1))))
    return F.transform(once, lambda s: F.struct(s["start"], s["stop"], s["kind"], s["value"]))


def base_spans(text: Column) -> Column:
    """The base spans of a text, kind by kind."""
    found = []
    for kind, pattern in PATTERNS.items():
        hint = F.contains(text, F.lit(HINTS[kind])) & text.rlike(pattern)
        found.append(F.when(hint, spans_of(_matches(text, pattern), kind, partial(_valid, kind))).otherwise(F.expr(NO_SPANS)))
    return F.concat(*found)


def _candidates(text: Column, base: Column) -> Column:
    """Identifier-like tokens of a text whose word no base span touches."""
    cut = F.struct(F.regexp_extract_all(text, F.lit(NEXT_CANDIDATE), F.lit(2)).alias("m"), F.regexp_extract_all(text, F.lit(NEXT_CANDIDATE), F.lit(1)).alias("g"))
    like = F.transform(spans_of(cut, "other", lambda m: m.rlike(LIKE)), _bare)
    all_ = F.when(text.rlike(LIKE), F.filter(like, lambda s: F.length(s["value"]) >= LEAST_CHARS)).otherwise(F.expr(NO_SPANS))
    # By first word, base spans before the candidate of the same word: a running maximum of their last words tells
    # whether one of them covers the candidate's.
    def placed(spans: Column, r: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["first"].alias("at"), F.lit(r).alias("r"), s.alias("s")))

    keyed = F.array_sort(F.concat(placed(base, 0), placed(all_, 1)))
    covered = lambda a: running(F.transform(a, lambda x: F.when(x["r"] == 0, x["s"]["last"]).otherwise(-1)), F.greatest)
    free = let(let(keyed, lambda a: F.struct(a.alias("a"), covered(a).alias("c"))), lambda z: F.filter(z["a"], lambda x, i: (x["r"] == 1) & (F.get(z["c"], i) < x["at"])))
    return F.when(F.size(base) == 0, all_).otherwise(F.transform(free, lambda x: x["s"]))


PATTERN_OF = """filter(array(
    CASE WHEN {at} >= 2 THEN named_struct('pattern', xxhash64('L2', {w}[{at} - 2], {w}[{at} - 1]), 'place', {place}) END,
    CASE WHEN {one} AND {at} >= 1 AND {at} + 1 < size({w}) THEN named_struct('pattern', xxhash64('LR', {w}[{at} - 1], {w}[{at} + 1]), 'place', {place}) END),
    z -> z IS NOT NULL)"""


def _patterns(w: str, at: str, one: str) -> str:
    """The patterns around word number `at` of the array w, each with the place that it is: the three words from there.
    The pattern of the words on both sides holds for slots of one word."""
    return PATTERN_OF.format(w=w, at=at, one=one, place=f"xxhash64({w}[{at}], get({w}, {at} + 1), get({w}, {at} + 2))")


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (keep), base (base spans) and marks (seeds and candidates with their patterns) of each row."""
    text = docs.select(row_of(keep).alias("row"), text_of().alias("text"))
    found = text.withColumn("base", base_spans(F.col("text")))
    # The explode of one row keeps Catalyst from unfolding the spans into every expression below.
    found = found.select("row", "text", F.explode(F.array("base")).alias("base"))
    found = found.withColumn("all", F.concat("base", _candidates(F.col("text"), F.col("base"))))
    found = found.select("row", "text", "base", F.explode(F.array("all")).alias("all"))
    words = F.when(F.size("all") > 0, words_of(F.lower("text"))).otherwise(F.array().cast("array<string>"))
    found = found.select("row", "base", "all", F.explode(F.array(words)).alias("w"))
    marks = f"transform(all, s -> named_struct('start', s.start, 'stop', s.stop, 'kind', s.kind, 'value', s.value, 'patterns', {_patterns('w', 's.first', 's.first = s.last')}))"
    return found.select("row", "base", F.expr(marks).alias("marks"))


def place_counts(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern and T, its distinct places in docs, for the given patterns (column pattern)."""
    w = docs.select(F.explode(F.array(words_of(F.lower(text_of())))).alias("w"))
    rows = w.select(F.explode(F.expr(f"flatten(transform(sequence(0, greatest(size(w) - 1, 0)), i -> CASE WHEN size(w) > 0 THEN {_patterns('w', 'i', 'true')} ELSE array() END))")).alias("z")).select("z.*")
    known = F.broadcast(patterns) if patterns.count() * 16 <= BROADCAST_BYTES else patterns
    return rows.join(known, "pattern").groupBy("pattern").agg(F.count_distinct("place").alias("T"))


def discovered(docs: DataFrame, marks: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """value and kind of the identifiers that confident patterns extract. marks: one row per seed or candidate."""
    edges = written(marks.select("kind", "value", F.explode("patterns").alias("z")).select("kind", "value", "z.*").distinct())
    unsure = F.col("kind").isin("other", "key")
    # Only patterns that some candidate stands in can extract anything; values and places: what F and P can come to in
    # any round, when every candidate is known.
    counted = edges.groupBy("pattern").agg(F.bool_or(unsure).alias("some"), F.count_distinct("value").alias("values"), F.count_distinct("place").alias("places"))
    enough = written(counted.where(F.col("some") & (F.col("values") >= LEAST_SEEDS)).select("pattern", "places", F.lit(0).cast("long").alias("T")))
    # The places in a part of the texts are a lower bound of all: patterns that fail by it would fail by the whole
    # count, and go before the larger part is counted. Those that are left are counted in all texts.
    for parts in STAGES:
        if enough.isEmpty():
            break
        part = docs.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0) if parts > 1 else docs
        counts = place_counts(part, enough.select("pattern"))
        enough = written(enough.drop("T").join(counts, "pattern", "left").fillna(0, ["T"]).where(F.col("T") * LEAST_SHARE <= F.col("places")))
    graph = written(edges.join(enough.select("pattern", "T"), "pattern"))
    seeds = graph.where("kind <> 'other'")
    open_ = graph.where(unsure)
    lexicon, found = seeds, None
    for _ in range(rounds):
        kinds = lexicon.groupBy("pattern", "kind").agg(F.count_distinct("value").alias("f"))
        kinds = kinds.groupBy("pattern").agg(F.max_by("kind", F.struct("f", "kind")).alias("kind"))
        scores = lexicon.groupBy("pattern", "T").agg(F.count_distinct("value").alias("F"), F.count_distinct("place").alias("P"))
        scores = scores.where((F.col("F") >= LEAST_SEEDS) & (F.col("P") >= LEAST_SHARE * F.col("T"))).join(kinds, "pattern")
        weighed = open_.select("value", "pattern").distinct().join(scores.select("pattern", "kind", F.log2(F.col("F") + 1).alias("weight")), "pattern")
        new = weighed.groupBy("value").agg(F.avg("weight").alias("w"), F.max_by("kind", F.struct("weight", "kind")).alias("kind"))
        found = written(new.where(F.col("w") >= LEAST_WEIGHT).select("value", "kind"))
        if found.isEmpty():
            break
        lexicon = seeds.unionByName(open_.drop("kind").join(found, "value").select(*seeds.columns))
    return found


def detect(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, base (base spans) and spans (with those the method adds): arrays of struct<start, stop, kind, value>.

    Offsets are code points, stop exclusive; spans go by start, then kind. A null or empty text has none. Texts are
    read whole. Rows are told apart by their place in the table, so null or repeated ids do not matter: equal texts get
    equal spans, and an empty table gives an empty one. A column of keep named base or spans gives way to the result.
    """
    return _detected(docs, keep).select(*fields_of("row", kept(keep, "base", "spans")), "base", "spans")


def _detected(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row, base and spans."""
    found = written(scanned(docs, keep).withColumn("at", F.monotonically_increasing_id()))
    marks = found.select("at", F.explode("marks").alias("m")).select("at", "m.*")
    with Scratch(docs.sparkSession) as scratch:
        lexicon = scratch.keep(discovered(docs, marks.select("kind", "value", "patterns")))
    more = marks.where("kind IN ('other', 'key')").select("at", "start", "stop", "value").join(lexicon, "value")
    more = more.groupBy("at").agg(F.collect_list(F.struct("start", "stop", "kind", "value")).alias("more"))
    both = found.join(more, "at", "left")
    base = F.transform("base", lambda s: F.struct(s["start"], s["stop"], s["kind"], s["value"]))
    added = F.coalesce("more", F.expr("cast(array() AS array<struct<start:int,stop:int,kind:string,value:string>>)"))
    return both.select("row", _ordered(base).alias("base"), _ordered(F.concat(base, added)).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """text with each span, or run of overlapping spans, replaced by the kind of its first one in brackets."""
    # What ends before a span: a new run begins where that is not beyond the span's start.
    ends = running(F.transform(spans, lambda s: s["stop"]), F.greatest)
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)))

    def part(pieces: Column, a: Column, b: Column) -> Column:
        """Code points [a, b): only the pieces they lie in are looked through."""
        first = F.floor(a / PIECE).cast("int")
        near = F.array_join(F.slice(pieces, first + 1, F.floor(b / PIECE).cast("int") - first + 1), "")
        return F.substring(near, a - first * PIECE + 1, b - a)

    def written_out(z: Column) -> Column:
        runs = F.transform(z["s"], lambda s, i: F.struct(F.coalesce(F.get(z["e"], i - 1), F.lit(0)).alias("a"), s["start"].alias("b"), s["kind"].alias("kind")))
        runs = F.filter(runs, lambda r: r["a"] <= r["b"])
        said = F.transform(runs, lambda r: F.concat(part(z["p"], r["a"], r["b"]), F.lit("["), F.upper(r["kind"]), F.lit("]")))
        end = F.element_at(z["e"], -1)
        return F.concat(F.array_join(said, ""), part(z["p"], end, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(spans.alias("s"), ends.alias("e"), pieces.alias("p")), written_out))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of personal data in text replaced by its kind in brackets; n_chars follows if there is one.

    Overlapping spans are one, named for the first. A text without spans stays as it is, null included. Needs text;
    other columns pass through whatever their names. Null and repeated ids, repeated rows and empty tables are as in
    detect().
    """
    found = _detected(docs, docs.columns).select("row", F.explode(F.array("spans")).alias("spans"))
    text = F.when(F.size("spans") == 0, F.col("row")["text"]).otherwise(replaced(F.col("row")["text"], F.col("spans")))
    changed = found.select("row", text.alias("text"))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("text"))
        elif c == "n_chars":
            out.append(F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(F.col("row").getField(c).alias(c))
    return changed.select(*out)


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base spans by kind, their digest, and all spans, for every document."""
    found = detect(documents(spark, sf_dir), ["doc_id"])
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))

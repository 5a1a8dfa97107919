"""The life of detection rules: validation, identity, merging, overrides, composition, and matching of arguments."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteloom.operators.state import cut

#: What a rule may be.
ROLES, MATCHES = ("source", "sink", "sanitizer", "propagation"), ("name", "full", "code", "arg_literal", "arg_count")


def compiling(rules: DataFrame, pattern: str) -> DataFrame:
    """rules with `compiles`: whether the pattern is a regular expression of the engine that will run it, which is asked
    itself; a null pattern is none."""
    made = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col(pattern))
    return rules.withColumn("compiles", F.col(pattern).isNotNull() & made.isNotNull())


def verdict(rules: DataFrame, allowed: DataFrame) -> DataFrame:
    """rules with `verdict`: the first test that a rule (role, match, pattern, category, cwe) fails, or "valid": its role,
    its match, a pattern that compiles, none that holds a path, and a pair of category and class that is allowed."""
    pairs = allowed.select("category", "cwe").distinct().withColumn("_allowed", F.lit(True))
    known = compiling(rules, "pattern").join(pairs, ["category", "cwe"], "left")
    tokens = F.split("pattern", "[^A-Za-z0-9_./]+")
    tests = [
        ("role", F.col("role").isin(*ROLES)),
        ("match", F.col("match").isin(*MATCHES)),
        ("regex", F.col("compiles")),
        ("path", ~F.exists(tokens, lambda t: F.contains(t, F.lit("/")))),
        ("category", F.coalesce("_allowed", F.lit(False))),
    ]
    found = F.lit("valid")
    for name, holds in reversed(tests):
        found = F.when(F.coalesce(holds, F.lit(False)), found).otherwise(name)
    return known.withColumn("verdict", found).drop("compiles", "_allowed")


#: Roles that a generated rule may enforce, and places of a call that a rule may speak of.
ENFORCED, PLACES = ("sink", "source", "sanitizer", "propagator"), r"^(return|receiver|call|arg:[1-9][0-9]*)$"


def rule_id(role: Column, cwe: Column, pattern: Column, endpoint: Column, prefix: str = "rule.") -> Column:
    """A prefix and sixteen digits of the SHA-256 of role|cwe|pattern|endpoint; nulls are empty."""
    parts = (F.coalesce(p.cast("string"), F.lit("")) for p in (role, cwe, pattern, endpoint))
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16)))


def exact_pattern(name: Column) -> Column:
    """The pattern of exactly one name: signs with a meaning in patterns, and white space, are quoted one by one."""
    return F.concat(F.lit("^"), F.regexp_replace(name, r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0b\f])", r"\\$1"), F.lit("$"))


def identified(rules: DataFrame, prefix: str = "rule.") -> DataFrame:
    """Generated rules (role, cwe, match, pattern, endpoint, full_name, internal, resolved, confidence, rule_id) with their id,
    kept if they have one, and `enforce`: whether their call is resolved, their pattern is exactly its full name (matched as
    such: `full`, or `internal_parameter` for an internal parameter), their confidence is high and their role may be. Rules
    whose endpoint is no place of a call are left out."""
    exact = F.col("full_name").isNotNull() & (F.col("pattern") == exact_pattern(F.col("full_name")))
    matched = F.when(F.col("match") == "internal_parameter", F.col("internal") & exact).otherwise((F.col("match") == "full") & exact)
    sure = F.col("resolved") & matched & (F.lower("confidence") == "high") & F.col("role").isin(*ENFORCED)
    made = rule_id(F.col("role"), F.col("cwe"), F.col("pattern"), F.col("endpoint"), prefix)
    return rules.where(F.col("endpoint").rlike(PLACES)).withColumns({"rule_id": F.coalesce(F.nullif("rule_id", F.lit("")), made), "enforce": F.coalesce(sure, F.lit(False))})


def merged(sets: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """One rule a key, that of the first set which has it, with merged_from (the sets that have it, in order) and
    n_roles; more than one role is a conflict."""
    every = None
    for place, (name, rules) in enumerate(sets):
        rows = rules.select(*key, "role", F.lit(place).alias("_place"), F.lit(name).alias("_set"))
        every = rows if every is None else every.unionByName(rows)
    sources = F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("_place", "_set"))), lambda x: x["_set"]))
    return every.groupBy(*key).agg(F.min(F.struct("_place", "role"))["role"].alias("role"), F.array_join(sources, "+").alias("merged_from"), F.count_distinct("role").alias("n_roles"))


def overridden(rules: DataFrame, cache: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """rules with the cache's values where it has the key; a cached role of "none" takes the rule away."""
    known = cache.select(*key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_cached"))
    rows = rules.join(known, key, "left")
    for c in columns:
        rows = rows.withColumn(c, F.when(F.col("_cached"), F.col(f"_{c}")).otherwise(F.col(c)))
    return rows.where("role <> 'none'").drop("_cached", *(f"_{c}" for c in columns))


def overlaid(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """base with the values of changes that are not null, and the changes whose key base lacks (which are errors)."""
    known = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = base.join(known, F.col(key) == F.col("_key"), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop("_key", *(f"_{c}" for c in columns))
    return out, changes.join(base.select(key), key, "left_anti")


def local_names(names: DataFrame, name: str, packages: DataFrame, package: str) -> DataFrame:
    """The distinct names that lie in one of the packages: a name's own prefixes before its dots meet the packages by
    equality. A package itself lies in no package of its name."""
    parts = F.split(F.col(name), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    each = names.select(name).distinct().where(F.size(parts) > 1)
    return each.select(name, F.explode(prefixes).alias("_p")).join(packages.select(F.col(package).alias("_p")).distinct(), "_p").select(name).distinct()


def without_local(calls: DataFrame, id: str, name: str, packages: DataFrame, package: str) -> DataFrame:
    """calls (a row for each full name of a call) without those whose every name is resolved and lies in one of the packages.
    Names that are null, empty or begin with "<" are not resolved, and one of them keeps the call."""
    resolved = F.coalesce((F.col(name) != "") & ~F.startswith(name, F.lit("<")), F.lit(False))
    local = local_names(calls.where(resolved), name, packages, package).withColumn("_local", F.lit(True))
    judged = calls.select(id, name, resolved.alias("_resolved")).join(local, name, "left")
    gone = judged.groupBy(id).agg(F.bool_and(F.col("_resolved") & F.coalesce("_local", F.lit(False))).alias("_all")).where("_all").select(id)
    return calls.join(gone, id, "left_anti")


def latest_answers(answers: DataFrame, id: str, attempt: str, answer: str) -> DataFrame:
    """id, answer and missing: the answer of the latest attempt that has one; ids without any are to be asked again."""
    found = answers.groupBy(id).agg(F.max_by(F.col(answer), F.when(F.col(answer).isNotNull(), F.col(attempt))).alias("answer"))
    return found.withColumn("missing", F.col("answer").isNull())


def argument_matches(calls: DataFrame, keep: list[str], args: str, rules: list[tuple[str, str, str | int]]) -> DataFrame:
    """keep and rule_id of the rules (id, match, value) that hold for an array of arguments: `arg_literal`, some argument
    matches the pattern as a whole; `arg_count`, there are so many."""
    hits = [F.when(_holds(args, match, value), F.lit(rule)) for rule, match, value in rules]
    return calls.select(*keep, F.explode(F.array_compact(F.array(*hits))).alias("rule_id"))


def _holds(args: str, match: str, value: str | int) -> Column:
    if match == "arg_count":
        return F.size(args) == value
    return F.exists(args, lambda a: a.rlike(f"^(?:{value})$"))


#: Letters of a gram, bytes of rules that are sent to every executor; more of them meet the texts by a shuffle.
GRAM, RULE_BYTES = 3, 32 << 20


def literal_of(pattern: str | None) -> str | None:
    """The longest run of plain letters that every match of a regular expression holds, null if none of GRAM letters is sure:
    classes, groups, optional letters and alternatives give none, nor do patterns that change what letters mean."""
    if not pattern or re.search(r"[(][?][a-zA-Z-]*[ixudU]|[\\][QE]", pattern):
        return None
    runs, run, depth, at = [], "", 0, 0
    while at < len(pattern):
        c, step, plain = pattern[at], 1, None
        if c == "\\":
            step = 2
            plain = pattern[at + 1 : at + 2] if not pattern[at + 1 : at + 2].isalnum() else None
        elif c == "[":
            inside, step = 1, 1
            while at + step < len(pattern) and inside:
                d = pattern[at + step]
                step += 2 if d == "\\" else 1
                inside += (d == "[") - (d == "]")
        elif c == "|" and depth == 0:
            return None
        elif c == "{":
            step = pattern.find("}", at) - at + 1 or len(pattern)
        elif c not in "^$.()?*+|":
            plain = c
        depth += (c == "(") - (c == ")")
        if c in "?*{" and pattern[at - 1 : at] not in (")", "]") and run:
            run = run[:-1]
        if plain is None or depth:
            runs.append(run)
            run = ""
        else:
            run += plain
        at += step
    best = max([*runs, run], key=len)
    return best if len(best) >= GRAM else None


def _grams(text: Column) -> Column:
    """The distinct runs of GRAM letters of a text, by one pass over its letters (bound once, as an element of an array)."""

    def runs(letters: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(letters) - GRAM, F.lit(0)))
        return F.array_distinct(F.array_compact(F.transform(places, lambda i: F.concat(*(F.get(letters, i + k) for k in range(GRAM))))))

    return F.get(F.transform(F.array(F.split(text, "")), runs), F.lit(0))


def _held(literals: frozenset[str]):
    """A function for the literals that a text holds: those whose first gram it has are looked for."""
    begins: dict[str, list[str]] = {}
    for literal in sorted(literals):
        begins.setdefault(literal[:GRAM], []).append(literal)

    def held(texts: pd.Series) -> pd.Series:
        found = []
        for t in texts:
            runs = {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)} if t is not None else set()
            found.append([x for gram in runs & begins.keys() for x in begins[gram] if x in t])
        return pd.Series(found, dtype=object)

    return F.pandas_udf(held, T.ArrayType(T.StringType()))


@F.pandas_udf(T.StringType())
def _literals(patterns: pd.Series) -> pd.Series:
    return patterns.map(literal_of)


def matches_of(rows: DataFrame, keep: list[str], text: str, rules: DataFrame, id: str = "rule_id", pattern: str = "pattern") -> DataFrame:
    """keep and rule_id of the rules whose pattern is found in a row's text, for many rules from a table.

    Rules of a sure literal are tried on the texts that hold it whole, unless they are nothing else. Up to RULE_BYTES of
    rules are sent to every task, which looks for their literals while a text is one row; beyond, a rule has one key, the
    gram of its literal that fewest rules hold, and texts meet rules by that key. Rules without a literal are tried on every
    text. Patterns that do not compile and null texts match nothing.
    """
    known = cut(compiling(rules.select(F.col(id).alias("_rule"), F.col(pattern).alias("_pattern")), "_pattern").where("compiles").drop("compiles").withColumn("_literal", _literals("_pattern")))
    size = known.agg(F.coalesce(F.sum(F.length("_pattern") + 64), F.lit(0))).first()[0]
    sent = F.broadcast if size <= RULE_BYTES else (lambda d: d)
    tried = F.expr(f"_pattern = _literal OR `{text}` rlike _pattern")
    rest = rows.join(sent(known.where("_literal IS NULL").select("_rule", "_pattern")), F.expr(f"`{text}` rlike _pattern"))
    if size <= RULE_BYTES:
        sure = known.where("_literal IS NOT NULL")
        held = _held(frozenset(r["_literal"] for r in sure.select("_literal").distinct().collect()))
        met = rows.withColumn("_literal", F.explode(held(F.col(text)))).join(F.broadcast(sure), "_literal").where(tried)
        return met.select(*keep, "_rule").unionByName(rest.select(*keep, "_rule")).withColumnRenamed("_rule", id)
    choices = known.where("_literal IS NOT NULL").select("_rule", F.explode(_grams(F.col("_literal"))).alias("_gram"))
    held = choices.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    key = choices.join(held, "_gram").groupBy("_rule").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    indexed = cut(known.join(key, "_rule"))
    wanted = indexed.agg(F.coalesce(F.collect_set("_gram"), F.array().cast("array<string>")).alias("_wanted"))
    texts = rows.where(F.col(text).isNotNull()).join(F.broadcast(wanted)).withColumn("_hits", F.array_intersect(_grams(F.col(text)), "_wanted")).drop("_wanted")
    met = texts.withColumn("_gram", F.explode("_hits")).join(sent(indexed), "_gram").where(F.contains(text, "_literal") & tried)
    both = met.select(*keep, "_rule").unionByName(rest.select(*keep, "_rule"))
    return both.withColumnRenamed("_rule", id)


def sanitizing(elements: DataFrame, sanitizers: DataFrame, code: str, category: str) -> DataFrame:
    """The flow elements with each sanitizer (pattern, applies_to) that applies to all ("*") or to their category, and
    whose pattern is found in their code."""
    rules = sanitizers.select("pattern", "applies_to").distinct().withColumn("_pair", F.struct("pattern", "applies_to"))
    found = matches_of(elements, elements.columns, code, rules, "_pair")
    out = found.select(*elements.columns, "_pair.*")
    return out.where(F.array_contains("applies_to", "*") | F.expr(f"array_contains(applies_to, `{category}`)"))


def suffix_matches(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """left joined with the rows of right whose path is the end of left's, or the other way round, in whole parts. Both
    share their last part, which is the key."""
    last = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    met = left.withColumn("_last", last(a)).join(right.withColumn("_last", last(b)), "_last")
    ends = F.endswith(F.concat(F.lit("/"), F.col(a)), F.concat(F.lit("/"), F.col(b))) | F.endswith(F.concat(F.lit("/"), F.col(b)), F.concat(F.lit("/"), F.col(a)))
    return met.where(ends).drop("_last")


def prefix_allowed(value: Column, allowed: Column) -> Column:
    """Whether a value begins with one of the allowed prefixes (an array), or "*" is among them."""
    return F.exists(allowed, lambda p: (p == "*") | F.startswith(value, p))


def accepted(rows: DataFrame, truth: str, guess: str, tree: DataFrame) -> DataFrame:
    """rows with `accepted`: the guess is the truth, its parent or one of its children (tree: parent, child)."""
    near = tree.select(F.col("parent").alias("_t"), F.col("child").alias("_g")).unionByName(tree.select(F.col("child").alias("_t"), F.col("parent").alias("_g"))).distinct().withColumn("_near", F.lit(True))
    met = rows.join(near, (F.col(truth) == F.col("_t")) & (F.col(guess) == F.col("_g")), "left")
    return met.withColumn("accepted", (F.col(truth) == F.col(guess)) | F.col("_near").isNotNull()).drop("_t", "_g", "_near")

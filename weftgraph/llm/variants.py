"""Problem 7: linking variant spellings of names.

Names become *forms* (sorted plain tokens). Tokens that look alike are found, completely for what the verifier accepts, by deletion neighbourhoods (slips), by
prefixes and consonants (abbreviations) and, where they are too long for deletions, by a prefix-filtered set-similarity join on their q-grams. Candidate forms are verified by a soft
weighted token alignment in which rare tokens count more. Pairs that leave a token of both sides unmatched are different names (relatives, sister
companies); pairs in which one side lacks or abbreviates a token down to an initial are *weak*: they link only if all they could mean is one entity.
Aliases given by responses link further.

Candidates by the weighted prefix bound. Whatever ``compare`` links, strongly or weakly, has a side every token of which, but for initials, is matched
above an initial: strong links leave no token of either side, weak ones none of the side that lacks something. Of that side any one token will do as
its prefix, so each form is looked up by its rarest token alone, exactly and by the tokens alike to it; no pair the verifier would accept is missed, at any corpus size.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import is_known, normalize_text
from weftgraph.llm.components import hash_to_min
from weftgraph.llm.setjoin import similarity_join, word_grams
from weftgraph.session import discard, materialize

GRAM = 3
THRESHOLD = 0.4
SOFT = 0.8
SHORT = 16

#: Words that carry no identity (fixed values): articles, titles, legal forms.
EMPTY_WORDS = frozenset(
    "the of and an mr mrs ms miss dr prof sir fa messrs gmbh ag ltd limited inc incorporated corp corporation co company llc plc sa srl bv kg oy ab".split()
)
_ACRONYM = re.compile(r"\(([A-Z]{2,6})\)")
_CAMEL = re.compile(r"(?<=[a-z]{2})(?=[A-Z][a-z])")
_WORDS = re.compile(r"[^\W_]+")


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def edits(a: str, b: str, most: int) -> bool:
    if one_edit(a, b):
        return True
    if most < 2 or abs(len(a) - len(b)) > 2:
        return False
    before, row, prior = None, list(range(len(b) + 1)), None
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and prior == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        before, row, prior = row, new, x
    return row[-1] <= most


def _deletions(s: str, most: int) -> set[str]:
    out = step = {s}
    for _ in range(most):
        step = {t[:i] + t[i + 1 :] for t in step for i in range(len(t))}
        out = out | step
    return out


def _shortened(a: str, b: str) -> bool:
    """Whether a is the beginning of b, or its first letter and some of its consonants in order."""
    if not 3 <= len(a) < len(b) or a[0] != b[0]:
        return False
    if b.startswith(a):
        return len(b) - len(a) >= 2
    rest = iter(b)
    return all(c in rest for c in a) and len(a) <= len(b) - 2 and not set(a[1:]) & set("aeiou")


class Speller:
    """How names are read and compared, with the tables given: ``dictionary`` (abbreviation to words), ``nicknames`` (short form to full form), ``synonyms`` (word to word)."""

    def __init__(self, dictionary: dict[str, str] | None = None, nicknames: dict[str, str] | None = None, synonyms: dict[str, str] | None = None):
        self.dictionary, self.nicknames, self.synonyms = dictionary or {}, nicknames or {}, synonyms or {}

    def tokens_of(self, name: str) -> list[str]:
        """Plain tokens of a name, sorted; empty for a name without letters or digits."""
        s = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).strip()
        s = _ACRONYM.sub(lambda m: " " if m[1].lower() == "".join(w[0] for w in _WORDS.findall(s[: m.start()])).lower() else f" {m[1]} ", s)
        if " " not in s:
            s = _CAMEL.sub(" ", s)
        s = s.lower()
        s = re.sub(r"(?<=[a-z])0(?![0-9])|(?<![0-9a-z])0(?=[a-z])", "o", s)
        s = re.sub(r"\b(?:[^\W\d_]\.){2,}(?:[^\W\d_]\b)?", lambda m: m[0].replace(".", ""), s)  # G.m.b.H. is a word
        words = _WORDS.findall(s)
        if s.startswith("@") and len(words) == 1 and len(words[0]) > 4:
            words = [words[0][0], words[0][1:]]
        out = []
        for w in words:
            out += _WORDS.findall(self.dictionary.get(w, w))
        out = [self.synonyms.get(w, w) for w in out]
        out = [w for w in out if w not in EMPTY_WORDS] or out
        return sorted(self.nicknames.get(w, w) for w in out) if len(out) > 1 else out

    def soft_match(self, a: str, b: str) -> float:
        """1 equal, 0.9 one slip (two from eight letters on), 0.85 abbreviation, 0.5 initial, 0 different."""
        if a == b:
            return 1.0
        if min(len(a), len(b)) == 1:
            return 0.5 if a[0] == b[0] else 0.0
        if min(len(a), len(b)) >= 4 and edits(a, b, 2 if min(len(a), len(b)) >= 8 else 1):
            return 0.9
        full_a, full_b = self.nicknames.get(a, a), self.nicknames.get(b, b)
        if full_a == full_b or _shortened(a, b) or _shortened(b, a) or min(len(full_a), len(full_b)) >= 5 and one_edit(full_a, full_b):
            return 0.85
        return 0.0

    def token_keys(self, token: str) -> set[tuple[str, int]]:
        """Keys (key, side) at which all pairs meet that ``soft_match`` finds alike: slips at a key of side 0, short (1) and full (2) tokens at each other's.

        Tokens longer than ``SHORT`` give no deletions: two slips leave them more grams in common than the join asks for.
        """
        full = self.nicknames.get(token, token)
        keys = {("=" + full, 0)}
        for word in {token, full}:
            if 4 <= len(word) <= SHORT + 2:
                keys |= {("-" + d, 0) for d in _deletions(word, 2 if len(word) >= 8 else 1)}
        n, rest = len(token), [c for c in token[1:] if c not in "aeiou"]
        if n >= 3:
            keys.add(("^" + token, 1))
            keys |= {("^" + token[:k], 2) for k in range(3, n - 1)}
            if len(rest) == n - 1:
                keys.add(("~" + token[:3], 1))
            keys |= {("~" + token[0] + c + d, 2) for i, c in enumerate(rest) for d in rest[i + 1 :]}
        return keys

    def compare(self, a: list[str], wa: list[float], b: list[str], wb: list[float]) -> int:
        """2: the same name; 1: a lacks or abbreviates what b has; -1: the other way round; 0: not shown to be the same. Equal tokens are matched first, then the heaviest alike."""
        free_a, free_b, gained, best, initials = list(range(len(a))), list(range(len(b))), 0.0, 0.0, [0, 0]
        for i, x in enumerate(a):
            for j in free_b:
                if b[j] == x:
                    free_a.remove(i)
                    free_b.remove(j)
                    gained += wa[i] + wb[j]
                    best = max(best, min(wa[i], wb[j])) if len(x) > 1 else best
                    break
        found = [(self.soft_match(a[i], b[j]), i, j) for i in free_a for j in free_b]
        found = sorted((m for m in found if m[0]), key=lambda m: -m[0] * (wa[m[1]] + wb[m[2]]) if m[0] > 0.5 else 1)
        for s, i, j in found:
            if i in free_a and j in free_b:
                free_a.remove(i)
                free_b.remove(j)
                gained += s * (wa[i] + wb[j])
                if s == 0.5:
                    initials[0 if len(a[i]) == 1 else 1] += 1
                else:
                    best = max(best, min(wa[i], wb[j]))
        left_a, left_b = [i for i in free_a if len(a[i]) > 1], [j for j in free_b if len(b[j]) > 1]
        lone_a, lone_b = len(left_a) < len(free_a), len(left_b) < len(free_b)
        # a middle initial may be missing, but an initial that fits none of the other's names is another name
        if not best or left_a and (left_b or lone_b) or left_b and lone_a:
            return 0
        if not left_a and not left_b and not any(initials):
            single = sum(w for x, w in [*zip(a, wa), *zip(b, wb)] if len(x) == 1)
            return 2 if gained / max(1e-9, sum(wa) + sum(wb) - single) >= SOFT else 0
        if (left_b or initials[0]) and not left_a and not initials[1]:
            return 1
        if (left_a or initials[1]) and not left_b and not initials[0]:
            return -1
        return 0


def soft_pairs(tokens: DataFrame, speller) -> DataFrame:
    """``(token, other)``, token < other: all pairs of different tokens of two or more letters that ``soft_match`` finds alike, but slips in long ones. ``speller`` is broadcast."""

    def spread(batches):
        for batch in batches:
            rows = [(t, *k) for t in batch.column(0).to_pylist() for k in speller.value.token_keys(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], ["token", "key", "side"])

    def verify(batches):
        match = speller.value.soft_match
        for batch in batches:
            yield batch.filter(pa.array([match(a, b) > 0.5 for a, b in zip(*(c.to_pylist() for c in batch.columns))], pa.bool_()))

    # 64-bit hashes of the keys are shuffled; what meets by chance is dropped by the verifier
    keys = tokens.filter(F.length("token") > 1).select("token").mapInArrow(spread, "token string, key string, side int").select("token", F.xxhash64("key").alias("key"), "side")
    met = keys.hint("merge").join(keys.toDF("other", "key", "other_side"), "key").filter("token <> other AND (side = 0 AND other_side = 0 OR side = 1 AND other_side = 2)")
    pairs = met.select(F.least("token", "other").alias("token"), F.greatest("token", "other").alias("other")).distinct()
    return pairs.mapInArrow(verify, "token string, other string")


def long_slips(tokens: DataFrame) -> DataFrame:
    """``(token, other)``, token < other: pairs of tokens longer than ``SHORT`` that two slips may part, those ``soft_pairs`` leaves out; shorter ones meet there."""
    words = tokens.filter(F.length("token") > SHORT).select("token", word_grams(F.col("token"), GRAM).alias("grams"))
    near = similarity_join(words, words, "token", "grams", THRESHOLD, same=True).select(F.col("left_key").alias("token"), F.col("right_key").alias("other"))
    return near.filter((F.abs(F.length("token") - F.length("other")) <= 2) & (F.levenshtein("token", "other") <= 4))


def response_aliases(responses: DataFrame) -> DataFrame:
    """``(name, alias)`` of the entities in model responses; what can't be read gives no row."""
    fence = re.compile(r"```(?:json)?\s*\n(.*?)\n```", re.S)

    def run(batches):
        for batch in batches:
            names, aliases = [], []
            for raw in batch.column(0).to_pylist():
                m = fence.search(raw)
                body = m[1] if m else raw[raw.find("{") : raw.rfind("}") + 1]
                try:
                    entities = json.loads(body).get("entities") or []
                except (ValueError, AttributeError, RecursionError):
                    continue
                for e in entities if isinstance(entities, list) else []:
                    if isinstance(e, dict) and isinstance(e.get("name"), str) and isinstance(e.get("aliases"), list):
                        for a in e["aliases"]:
                            if isinstance(a, str):
                                names.append(e["name"])
                                aliases.append(a)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(aliases, pa.string())], ["name", "alias"])

    return responses.select("raw_response").filter("raw_response LIKE '%aliases%'").mapInArrow(run, "name string, alias string")


def link_variants(names: DataFrame, aliases: DataFrame, dictionary: DataFrame, nicknames: DataFrame | None = None, synonyms: dict[str, str] | None = None) -> DataFrame:
    """``(name, entity)``: every known name of ``names`` (column name) with the entity it belongs to.

    ``aliases`` are pairs (name, alias) as written; ``dictionary`` is (key, value, line_no), the last line of a key counts; ``nicknames`` is (short, full), of a short form with several
    full ones the least counts. These two are hand-written files and sent to all tasks. Null, blank and meaningless names are left out, repeated names count once. An alias counts
    where name and alias are, but for their writing, known names and the alias does not go with more than two entities. Empty tables give no rows.
    All joins are merge joins: every broadcast, however small, takes pages of 4 MB and more of the driver.
    """
    spark = names.sparkSession
    held: list[DataFrame] = []

    def keep(df: DataFrame, what: str) -> DataFrame:
        held.append(materialize(df, what))
        return held[-1]

    lines = dictionary.select(normalize_text("key").alias("k"), "value", "line_no").groupBy("k").agg(F.max_by("value", "line_no").alias("v"))
    words = {r.k: r.v.lower() for r in lines.collect() if r.k and r.v}
    shorts = {} if nicknames is None else {r.short: r.full for r in nicknames.groupBy("short").agg(F.min("full").alias("full")).collect() if r.short and r.full}
    sent = spark.sparkContext.broadcast(Speller(words, shorts, synonyms))

    def form_rows(batches):
        for batch in batches:
            yield batch.append_column("form", pa.array([" ".join(sent.value.tokens_of(n)) for n in batch.column(0).to_pylist()], pa.string()))

    distinct = names.select(F.col("name").cast("string")).filter(is_known("name")).distinct()
    spelled = keep(distinct.mapInArrow(form_rows, "name string, form string").filter("form <> ''"), "spelled")
    forms = spelled.select("form").distinct()
    each = forms.select("form", F.explode(F.array_distinct(F.split("form", " "))).alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n"))
    total = max(1, forms.count())
    counts = keep(counts, "tokens")
    near = keep(long_slips(counts).unionByName(soft_pairs(counts, sent)).distinct(), "near")
    alike = keep(near.unionByName(near.select(F.col("other").alias("token"), F.col("token").alias("other"))), "alike")
    # a slip in a frequent word is not a rare token: it counts as often as the word it looks like
    often = alike.hint("merge").join(counts.toDF("other", "m"), "other").groupBy("token").agg(F.sum("m").alias("m"))
    rarity = keep(counts.hint("merge").join(often, "token", "left").select("token", "n", (F.col("n") + F.coalesce("m", F.lit(0))).alias("r")), "rarity")
    weight = F.log1p(F.lit(total) / F.col("n"))
    ranked = each.hint("merge").join(rarity, "token")
    rarest = F.min(F.when(F.length("token") > 1, F.struct("r", "token"))).alias("rarest")
    weighed = ranked.groupBy("form").agg(F.sort_array(F.collect_list(F.struct("token", weight.alias("w")))).alias("t"), rarest)
    weighed = keep(weighed.select("form", F.col("t.token").alias("tokens"), F.col("t.w").alias("weights"), F.col("rarest.token").alias("rarest")), "forms")

    asked = weighed.filter("rarest IS NOT NULL").select(F.col("form").alias("a"), F.col("rarest").alias("token"))
    asked = asked.unionByName(asked.hint("merge").join(alike, "token").select("a", F.col("other").alias("token")))
    pairs = asked.hint("merge").join(each.toDF("b", "token"), "token").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = [weighed.select(F.col("form").alias(s), F.col("tokens").alias(f"t{s}"), F.col("weights").alias(f"w{s}")) for s in "ab"]

    def verify(batches):
        for batch in batches:
            a, b, ta, wa, tb, wb = (c.to_pylist() for c in batch.columns)
            how = [sent.value.compare(*x) for x in zip(ta, wa, tb, wb)]
            at = [k for k, h in enumerate(how) if h]
            rows = [(a[k], b[k]) if how[k] > 0 else (b[k], a[k]) for k in at]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([abs(how[k]) == 2 for k in at], pa.bool_())], ["a", "b", "strong"])

    joined = pairs.hint("merge").join(sides[0], "a").hint("merge").join(sides[1], "b").select("a", "b", "ta", "wa", "tb", "wb")
    links = keep(joined.mapInArrow(verify, "a string, b string, strong boolean"), "links")
    first = hash_to_min(links.filter("strong"))
    entity = keep(forms.hint("merge").join(first.withColumnRenamed("vertex", "form"), "form", "left").select("form", F.coalesce("group_min", "form").alias("e")), "entities")

    a_side, b_side = entity.toDF("a", "ea"), entity.toDF("b", "eb")
    weak = links.filter("NOT strong").hint("merge").join(a_side, "a").hint("merge").join(b_side, "b").filter("ea <> eb").select("ea", "eb").distinct()
    # what a weak form could mean may itself be weak: only ends that are not count, where there are any
    ends = weak.hint("merge").join(weak.select(F.col("ea").alias("eb")).distinct().withColumn("open", F.lit(True)), "eb", "left")
    meant = ends.groupBy("ea").agg(F.count("*").alias("n"), F.count_if(F.col("open").isNull()).alias("n_full"), F.max("eb").alias("any"), F.max(F.when(F.col("open").isNull(), F.col("eb"))).alias("full"))
    meant = keep(meant.select("ea", F.when(F.col("n_full") == 1, F.col("full")).when((F.col("n_full") == 0) & (F.col("n") == 1), F.col("any")).alias("eb")), "weak")

    known = spelled.hint("merge").join(entity, "form").select("name", "e")
    given = aliases.select("name", "alias").filter("name <> alias").distinct().filter(is_known("name") & is_known("alias"))

    def said_rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(sent.value.tokens_of(n)) for n in c.to_pylist()], pa.string()) for c in batch.columns], ["a", "b"])

    said = given.mapInArrow(said_rows, "a string, b string").filter("a <> b").distinct().hint("merge").join(a_side, "a").hint("merge").join(b_side, "b").filter("ea <> eb")
    generic = said.groupBy("b").agg(F.count_distinct("ea").alias("n")).filter("n > 2").select("b")
    said = keep(said.hint("merge").join(generic, "b", "left_anti").select("ea", "eb").distinct(), "said")  # read three times below
    unclear = meant.filter("eb IS NULL").select("ea")
    # an alias of, or with, a form that may mean several entities settles what it means only if it is the one such
    both = said.unionByName(said.select(F.col("eb").alias("ea"), F.col("ea").alias("eb"))).distinct()
    settled = both.hint("merge").join(unclear, "ea").hint("merge").join(unclear.toDF("eb"), "eb", "left_anti").groupBy("ea").agg(F.count("*").alias("n"), F.max("eb").alias("eb")).filter("n = 1").select("ea", "eb")
    plain = said.hint("merge").join(unclear, "ea", "left_anti").hint("merge").join(unclear.toDF("eb"), "eb", "left_anti")
    edges = keep(meant.filter("eb IS NOT NULL").unionByName(settled).unionByName(plain).distinct(), "edges")
    last = hash_to_min(edges, "ea", "eb").toDF("e", "entity")
    out = materialize(known.hint("merge").join(last, "e", "left").select("name", F.coalesce("entity", "e").alias("entity")), "linked")
    for df in held:
        discard(df)
    return out


def variant_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of different spellings of an entity, name_a < name_b: the stated result, as large as the entities' spellings make it."""
    a, b = linked.select("entity", F.col("name").alias("name_a")), linked.select("entity", F.col("name").alias("name_b"))
    return a.hint("merge").join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")

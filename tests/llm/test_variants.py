import json
import random

from weftgraph.llm import nicknames
from weftgraph.llm import variants as v

WORDS = {"log": "logistics", "inc": "incorporated", "ltd": "limited", "tm": "team"}
SPELLER = v.Speller(WORDS, dict(nicknames.short_forms()), nicknames.SYNONYMS)


def test_tokens():
    t = SPELLER.tokens_of
    assert t("Jukébude, B.") == ["b", "jukebude"]
    assert t("VenkupaDiflijoGateway") == t("venkupa_diflijo-gateway") == ["diflijo", "gateway", "venkupa"]
    assert t("Jilinza Sarope Router (JSR)") == ["jilinza", "router", "sarope"]
    assert t("@izukepufi") == ["i", "zukepufi"]
    assert t("Doprakezi LOG Inc.") == ["doprakezi", "logistics"]
    assert t("the Beravolu team") == t("Beravolu (squad)") == ["beravolu", "squad"]
    assert t("Ott0kar X2000") == ["ottokar", "x2000"]
    assert t("Anni Melagesi") == ["anneliese", "melagesi"] and t("Anni") == ["anni"]
    assert t("Pukejudu Software, G.m.b.H.") == ["pukejudu", "software"]
    assert t("@agastofula") == ["a", "gastofula"]
    assert t("—") == []


def test_soft_match():
    assert SPELLER.soft_match("zack", "zacharias") == 0.85 and SPELLER.soft_match("tat", "tatjana") == 0.85 and SPELLER.soft_match("ptnrs", "partners") == 0.85
    assert SPELLER.soft_match("ledger", "legder") == 0.9 and SPELLER.soft_match("vault", "ledger") == 0.0 and SPELLER.soft_match("b", "bart") == 0.5
    assert v.edits("rudagurzi", "rudagruji", 2) and not v.edits("rudagurzi", "rudagruji", 1)


def link(spark, names, aliases=()):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    said = spark.createDataFrame(list(aliases), "name string, alias string")
    lines = spark.createDataFrame([(k, w, 1) for k, w in WORDS.items()], "key string, value string, line_no int")
    shorts = spark.createDataFrame(nicknames.short_forms(), "short string, full string")
    return {tuple(r) for r in v.variant_pairs(v.link_variants(df, said, lines, shorts, nicknames.SYNONYMS)).collect()}


def test_links(spark):
    names = [
        "Bartholomew Jukébude", "B. Jukébude", "Jukebude, Bartholomew", "Bart Jukebude", "Bartholomew Jukebdue", "Henrietta Jukebude",
        "Tivaji Wintapu Vault", "TivajiWintapuVault", "Tivaji Wintapu Ledger", "Doderedor Software Limited", "Doderedor Instruments", "Doderedor",
        "Squad Pelu", "the Pelu team", "Loklebu Tobada Holding", "n/a", None, "TBD", "  ", "H. Ambigu", "Henry Ambigu", "Hugo Ambigu", "Squad Pelu",
    ]
    got = link(spark, names, [("the Pelu team", "Loklebu Tobada Holding"), ("Squad Pelu", "they"), ("n/a", "Squad Pelu"), ("nobody", "Squad Pelu")])
    groups = [
        {"Bartholomew Jukébude", "B. Jukébude", "Jukebude, Bartholomew", "Bart Jukebude", "Bartholomew Jukebdue"},
        {"Tivaji Wintapu Vault", "TivajiWintapuVault"},
        {"Squad Pelu", "the Pelu team", "Loklebu Tobada Holding"},
    ]
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}


def test_empty_and_responses(spark):
    assert link(spark, []) == set()
    body = json.dumps({"entities": [{"name": "A", "aliases": ["B", 3, None]}, {"name": 5, "aliases": ["C"]}, {"aliases": []}, "x"], "relations": []})
    raws = [body, "Here:\n```json\n" + body + "\n```", "{broken aliases", None, '["aliases"]', '{"entities": "aliases"}']
    df = spark.createDataFrame([(r,) for r in raws], "raw_response string")
    assert [tuple(r) for r in v.response_aliases(df).collect()] == [("A", "B"), ("A", "B")]


def test_token_keys_are_complete():
    rng = random.Random(3)
    words = ["theodore", "ted", "teddy", "partners", "ptnrs", "part", "anna", "anni", "anneliese"]
    for _ in range(400):
        word = "".join(rng.choice("abcdeimnrst") for _ in range(rng.randint(3, 14)))
        other = list(word)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(other) - 1)
            other[i : i + 2] = rng.choice([other[i : i + 2][::-1], other[i : i + 1], [rng.choice("abcde"), other[i + 1]], [other[i], "x", other[i + 1]]])
            other = other if len(other) > 2 else list(word)
        words += [word, "".join(other), word[0] + "".join(c for c in word[1:] if c not in "aeiou")[:3]]
    keys = {w: SPELLER.token_keys(w) for w in set(words)}
    meets = lambda a, b: any((k, {0: 0, 1: 2, 2: 1}[side]) in keys[b] for k, side in keys[a])
    for a in keys:
        for b in keys:
            if a < b and min(len(a), len(b)) > 1 and SPELLER.soft_match(a, b) > 0.5:
                assert meets(a, b), (a, b)


def test_slips_beside_a_frequent_token(spark):
    rng = random.Random(4)
    names = ["Theodore " + "".join(rng.choice("bdfgklmnprtvz") for _ in range(10)) for _ in range(30)]
    pairs = [("Theodore Smith", "Theodore Smtih"), ("Theodore Zeka", "Theodore Zoka"), ("Theodore Hjalwumo", "Theodore Hjlawmuo"), ("Theodore Partners", "Theodore Ptnrs")]
    got = link(spark, names + [n for p in pairs for n in p])
    assert set(pairs) <= got


def test_rarest_token_finds_all_that_compares(spark):
    """Against all pairs of forms: the lookups by one token miss no strong link; without the tables, nicknames are not known."""
    rng = random.Random(12)
    first, last = ["theodore", "henrietta", "bartholomew", "anna", "lisa"], ["".join(rng.choice("bdfgklmnprtvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(25)]
    names = set()
    for _ in range(120):
        a, b = rng.choice(first), rng.choice(last)
        k = rng.randrange(len(b) - 1)
        names |= {f"{a} {b}", f"{b}, {a}", f"{a} {b[:k] + b[k + 1] + b[k] + b[k + 2:]}", f"{a[0]}. {b}", f"{a[:4]} {b}"}
    names = sorted(names)
    got = link(spark, names)
    forms = {n: SPELLER.tokens_of(n) for n in names}
    ones = lambda x: [1.0] * len(x)
    for i, a in enumerate(names):
        for b in names[:i]:
            if forms[a] != forms[b] and SPELLER.compare(forms[a], ones(forms[a]), forms[b], ones(forms[b])) == 2:
                assert (b, a) in got, (a, b)
    assert v.Speller().soft_match("ted", "theodore") == 0 and SPELLER.soft_match("ted", "theodore") == 0.85


def test_two_swaps_in_a_long_token(spark):
    """Tokens too long for deletions meet by their grams: two swaps leave 11 of 19, a Jaccard of 0.41."""
    got = link(spark, ["Theodore Bdikavolumetrosanip", "Theodore Bdiakvolumetorsanip"])
    assert got == {("Theodore Bdiakvolumetorsanip", "Theodore Bdikavolumetrosanip")}


def test_nothing_is_broadcast(spark):
    """Of no table, however small, a copy is built on the driver."""
    token = spark.createDataFrame([("partners",), ("ptnrs",)], "token string")
    linked = spark.createDataFrame([("a", "x"), ("b", "x")], "name string, entity string")
    sent = spark.sparkContext.broadcast(SPELLER)
    for df in (v.soft_pairs(token, sent), v.variant_pairs(linked)):
        assert df.count() == 1
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()

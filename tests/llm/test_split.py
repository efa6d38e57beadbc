import random

from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm.split import split_documents, split_text


def check(text, limit, overlap):
    spans = split_text(text, limit, overlap)
    assert "".join(text[n:e] for _, n, e in spans) == text
    assert all(0 < e - s <= limit and s <= n < e for s, n, e in spans)
    for (s0, n0, e0), (s1, n1, e1) in zip(spans, spans[1:]):
        assert n1 == e0 and s1 >= s0 and e0 - s1 <= overlap
        if e0 - s0 > overlap:
            assert e0 - s1 >= min(overlap, e0 - s0) // 2
    return spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #\n-.`|é́‍", max_size=600), st.integers(20, 120), st.integers(0, 30))
def test_round_trip(text, limit, overlap):
    check(text, limit, min(overlap, limit // 2))


def test_natural_boundaries():
    rng = random.Random(3)
    para = lambda n: " ".join("w" * rng.randint(2, 9) for _ in range(n)) + ". Next one here."
    text = "# Top\n\n" + "\n\n".join(f"## Part {k}\n\n{para(90)}\n\n- item a\n  - item b\n- {para(20)}" for k in range(12))
    spans = check(text, 2000, 200)
    assert len(spans) > 4
    for _, new, end in spans[:-1]:
        assert text[end - 1] in "\n " and not text[new:end].rstrip().rsplit("\n", 1)[-1].startswith("#")


def test_fenced_code_is_kept_whole():
    code = "```\n" + "x = 1\n\n# not a heading\n" * 20 + "```\n"
    text = "para one. " * 120 + "\n\n" + code + "\n\n" + "para two. " * 120
    spans = check(text, 1500, 100)
    assert any(code.strip() in text[n:e] for _, n, e in spans)


def test_one_endless_word_and_blank_text():
    assert len(check("x" * 9000, 2000, 200)) == 5
    check(" " * 5000, 2000, 200)
    check("漢字。" * 2000, 2000, 200)
    assert split_text(None) == split_text("") == []
    assert split_text("short") == [(0, 0, 5)]


def test_dirty_table(spark):
    big = "One sentence here. " * 300
    rows = [("a", big, 1), ("a", big, 1), ("b", None, 2), ("c", "", 2), ("d", "x" * 2000, 3), (None, big, 4), ("e", "é" * 2001, 5)]
    df = spark.createDataFrame(rows, "doc_id string, text string, piece_no int")
    out = split_documents(df).collect()
    assert {r.doc_id for r in out} == {"a", None, "e"}
    assert all(len(r.piece) <= 2000 for r in out)
    assert len([r for r in out if r.doc_id == "a"]) == 2 * len([r for r in out if r.doc_id is None])
    assert split_documents(df.limit(0)).collect() == []

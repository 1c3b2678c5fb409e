"""Token alignment against whole texts encoded by both libraries and sets of ends."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hostwatch.llm import token_alignment as ta
from hostwatch.llm.queries import QUERIES

from .test_operators import ROWS, SF, docs, none, odd  # noqa: F401

TRICKY = ["", " ", "a ", " a", "a  b", "a\n b", "a \nb", "a\nb", "x\t y", "a▁b c", "a b▁", "<s> </s> <unk> <|endoftext|> <0x41>", "a\x00b c",
          "日本語 テキスト 😀😀 한국어 😀", "é café", "\u0085 a", "a b  c", "a  b", "a᠎ b", "\x1c a \x1f", "ﬁ ½ Å",
          "don't we'll I'm it's 'tis 's", "1234567 3.14 $%& ###", "a" * 3000, "      many     blanks   ", "\n\n\n", "ab " * 500 + "cd", "x" + " " * 2500 + "y\n" + "\n" * 2100 + "z", None]


@pytest.fixture(scope="module")
def both():
    return ta.Tokenizers(*ta.tokenizer_paths())


def brute(tokenizers, rows):
    """{(doc_id, text): result} from whole texts, with ends as sets and every link listed."""
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(ta.tokenizer_paths()[0])
    library.encode_special_tokens = True
    found, counts = [], collections.Counter()
    for doc, text in rows:
        own = None
        if text:
            a = library.encode(" " + text, add_special_tokens=False).ids
            b = tokenizers.b.encode(text)
            data = (" " + text).encode()
            if all(b"".join(t[i] for i in ids) == data for t, ids in ((tokenizers.bytes_a, a), (tokenizers.bytes_b, b))):
                ends = []
                for ids, pieces in ((a, tokenizers.bytes_a), (b, tokenizers.bytes_b)):
                    at, own_ends = 0, []
                    for i in ids:
                        at += len(pieces[i])
                        own_ends.append(at)
                    ends.append(own_ends)
                cuts = sorted(set(ends[0]) & set(ends[1]))
                groups = collections.defaultdict(lambda: ([], []))
                for side, ids in enumerate((a, b)):
                    for i, end in zip(ids, ends[side]):
                        groups[next(c for c in cuts if c >= end)][side].append(i)
                own = (a, b, [groups[c] for c in cuts])
        found.append((doc, text, own))
        counts.update({(x, y) for g in (own[2] if own else ()) for x in g[0] for y in g[1]})
    most = collections.Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc, text, own in found:
        if not own:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for g in own[2] for x in g[0] for y in g[1]]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own[2])
        out.append((doc, len(own[0]), len(own[1]), len(own[2]), len(links), sum(counts[p] == most[p[0]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return collections.Counter(out)


def result(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", *ta.RESULTS).collect())


def test_whole_table(spark, docs, both):  # noqa: F811
    short = [(d, t) for d, t in docs if len(t) < 4000]
    got = QUERIES["op11_token_alignment"](spark, SF)
    assert got.columns == ["doc_id", *ta.RESULTS] and got.count() == len(docs)
    df = spark.createDataFrame(short, "doc_id long, text string").repartition(3)
    assert result(ta.align(df)) == brute(both, short)


def test_odd_texts_in_both_ways(spark, both):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(d, t) for d, t, *_ in ROWS if t is None or len(t) < 4000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(both, rows)
    assert result(ta.align(df)) == want
    assert result(ta.align(df, table_pairs=3)) == want


def test_very_long_runs(both):
    """Ids of both libraries agree where the faster one cannot match."""
    for text in (" " * 1_000_000 + "x", "a\n" + "\n" * 400_000, "a" * 300_000):
        assert both.ids_a(text) == both.slow.encode(text, add_special_tokens=False).ids


def test_odd_table(spark, odd):  # noqa: F811
    assert QUERIES["op11_token_alignment"](spark, odd).count() == len(ROWS)
    clash = spark.createDataFrame([(1, "a b", 7, "x", 2.0)], "doc_id long, text string, n_a int, block string, rows double")
    got = ta.align(clash).collect()[0].asDict()
    assert got["n_a"] == 2 and got["block"] == "x" and got["rows"] == 2.0


def test_groups(spark):
    df = spark.createDataFrame([(1, "Hello wörld 😀", 1), (2, None, 2), (3, "a▁b", 3)], "doc_id long, text string, groups int")
    got = {r.doc_id: r.groups for r in ta.aligned_groups(df).collect()}
    assert got[1][-1].end == len(" Hello wörld 😀".encode()) and got[2] == [] and got[3] == []


ascending = st.lists(st.integers(0, 60), unique=True).map(sorted)


@settings(max_examples=200, deadline=None)
@given(ascending, ascending)
def test_gallop(a, b):
    x, y = ta.common_ends(a, b)
    assert [a[i] for i in x] == [b[i] for i in y] == sorted(set(a) & set(b))


def test_large_groups_by_distinct_ids(both):
    """One group of many ids: distinct pairs with the number of their links."""
    found = both.encode(["x", "y"])
    found.a, found.b = np.array([1, 2] * 20 + [7]), np.array([3] * 30 + [8])
    found.part, found.first_a, found.first_b = np.array([0, 1]), np.array([0, 40]), np.array([0, 30])
    found.size_a, found.size_b, found.links = np.array([40, 1]), np.array([30, 1]), np.array([1200, 1])
    part, key, times = found.pairs()
    assert list(zip(part, key, times)) == [(0, 1 << 16 | 3, 600), (0, 2 << 16 | 3, 600), (1, 7 << 16 | 8, 1)]

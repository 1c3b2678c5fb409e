"""Every query against a plain version, on whole small tables and on a table of odd rows."""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hostwatch.llm import (bpe, chat_format, common, exact_dedup, fingerprints, jaccard_join, language_id, line_dedup, lm_scoring,
                           mixing, sharding)
from hostwatch.llm.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"
LONG = "a very long text of words that go on and on " * 4000
SENT = "One line that is shared by many of the documents here."
NEAR = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (0, f"The first text. It has two sentences.\n{SENT}", "en", "a"), (1, f"The first text. It has two sentences.\n{SENT}", "en", "a"),
    (2, None, None, None), (3, "", "en", "b"), (4, " \n\t ", "de", "b"), (5, LONG, "en", "a"), (5, LONG, "en", "a"),
    (None, "a text without an id, in several words\n  " + SENT.upper(), "fr", None), (None, None, None, "a"),
    (8, "Ünïcode straße 日本語 😀 <|endoftext|> end  of   it\x85", "de", "c"), (9, "12345 67890 !!", None, "c"),
    (10, NEAR, "en", "c"), (11, NEAR + " tail", "en", "c"), (12, NEAR.upper() + " tail more", "en", "a"), (-3, "x", "es", "b"),
    (13, "The first text. It has two\n sentences.\n" + SENT, "en", "zz"), (14, "tab\tand\x0bother\x0cspaces\r\nhere", "en", "")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h int, label string, ids int, row int"


def write(spark, folder, rows):
    full = [(*r, None if r[1] is None else len(r[1]), "s", 1, "l", 2, 3) for r in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(0, 1, 0, "x"), (1, 0, 1, "x"), (1, 1, 0, "x"), (None, 1, 1, "x"), (5, None, None, "x"), (8, 7, 1, "x"), (99, 1, 1, "x")]
    spark.createDataFrame(labels if rows else [], "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), ROWS)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    folder = write(spark, tmp_path_factory.mktemp("none"), [])
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "op4_chat_format"])
def test_empty_table(spark, none, name):
    assert QUERIES[name](spark, none).collect() == []


def test_fingerprints(spark, docs, odd):
    got = by_id(rows_of(QUERIES["op1_fingerprints"](spark, SF)))
    order, prints = sorted(docs, reverse=True), {}
    for i, (d, text) in enumerate(order):
        k = len(text) // 3
        edited = text[:len(text) - k] + order[(i + 1) % len(order)][1][:k]
        assert got[d]["n_chars"] == len(text) and got[d]["edited_sha256"] == brute.sha(edited)
        assert prints.setdefault(text, got[d]["fingerprint"]) == got[d]["fingerprint"]
        assert prints.setdefault(edited, got[d]["edited_fingerprint"]) == got[d]["edited_fingerprint"]
        assert got[d]["near_edited"] == pytest.approx(brute.likeness(text, edited))
        assert got[d]["near_next"] == pytest.approx(brute.likeness(text, order[(i + 1) % len(order)][1]))
    assert len(set(prints.values())) == len(prints)
    assert sum(r["near_edited"] > 0.5 for r in got.values()) > 0.8 * len(got)
    found = rows_of(QUERIES["op1_fingerprints"](spark, odd))
    assert len(found) == len(ROWS) and all(0 <= r[c] <= 1 for r in found for c in ("near_edited", "near_next"))
    a, b = (spark.range(1).select(fingerprints.tree(common.F.lit(t)).alias("t")).first().t for t in ("a. b.\nc\nd", "a. b.\nx\nd"))
    places = spark.range(1).select(fingerprints.edited_places(common.F.lit(a), common.F.lit(b)).alias("p")).first().p
    assert len(places) == 1


def test_sharding(spark, docs, odd):
    got = rows_of(QUERIES["op2_sharding"](spark, SF))
    size = {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in docs}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == size
    for found in (got, rows_of(QUERIES["op2_sharding"](spark, odd))):
        slots = collections.defaultdict(list)
        for r in found:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        counts = [len(slots[s]) for s in range(16)]
        assert max(counts) - min(counts) <= 1 and sum(counts) == len(found)
    assert len(rows_of(QUERIES["op2_sharding"](spark, odd))) == len(ROWS)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in rows_of(QUERIES["op2_sharding"](spark, SF))}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 97, 5000])
def test_permutation_is_a_bijection_and_goes_back(spark, n):
    df = spark.range(n).select("id", sharding.position_of(common.F.col("id"), n, 7).alias("p"))
    df = df.select("id", "p", sharding.number_at(common.F.col("p") % 4, common.div(common.F.col("p"), 4), n, 4, 7).alias("back"))
    got = df.collect()
    assert sorted(r.p for r in got) == list(range(n)) and all(r.back == r.id for r in got)
    assert n < 97 or sum(r.p == r.id for r in got) < n / 10


def check_bpe(rows, texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.tokenizer_path())
    want = collections.Counter()
    for d, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[d, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want


def test_bpe(spark, docs, odd):
    check_bpe(rows_of(QUERIES["op3_bpe"](spark, SF)), docs)
    check_bpe(rows_of(QUERIES["op3_bpe"](spark, odd)), [r[:2] for r in ROWS])


def test_word_keys_are_those_of_spark(spark):
    words = ["", "a", " the", "日本語", "x" * 100, "😀é", "0123456789abcdef0123456789abcdef!"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", common.F.xxhash64("w").alias("k"))
    assert {r.w: r.k for r in df.collect()} == {w: bpe.word_key(w) for w in words}


def test_bpe_all_ways_of_splitting_and_encoding_agree():
    """Plain parts are words without the pattern; what tiktoken encodes has the library's ids; lists are made from whole arrays."""
    from tokenizers import Tokenizer
    path = bpe.tokenizer_path()
    special, library, rng = bpe.Vocabulary(path).special, Tokenizer.from_file(path), np.random.default_rng(5)
    splitter = bpe.Splitter(path, list(special))
    plain = "Wort 42 straße 日本語の文 end"
    splitter.numbers(plain)
    pattern, splitter.pattern = splitter.pattern, None
    assert [w for x in splitter.words(0) for w in x] == [*pattern.findall(plain)[1:], "Wort"]
    splitter.pattern = pattern
    splitter.numbers("It's (not) here, x1 ²3 a٣")
    assert all(words == [p] if p in splitter.whole else words == pattern.findall(p) for p, words in zip(splitter.parts, splitter.words(0)))
    for text in ("a  b", "a \nb", "a\n b", "a \tb", "a\x85 b", "a \u2003b"):
        own = bpe.Splitter(path, list(special))
        assert [own.parts[k] for k in own.numbers(text)] == own.pattern.findall(text), repr(text)
    marks = ["a", "Wort", "'s", "'RE", "42", "٣", "..", "é", "ß", "日本", "😀", "\n", "\t", "\x85", "\u2003", "ԱԲ", "՘", "\x00", " "]
    entries = [*special, *marks, *(" " + m for m in marks), *("".join(rng.choice(marks, 5)) for _ in range(500)), "long" * 50]
    coded = bpe.Encoder(path, special).ids(entries)
    assert coded == [x.ids for x in library.encode_batch(entries, add_special_tokens=False)]
    lists = [np.array(x, np.int32) for x in ([1, 2], [], [3])]
    assert bpe.int_lists(lists).to_pylist() == [[1, 2], [], [3]] and bpe.int_lists([]).to_pylist() == []


def test_bpe_lookup_arrays_hold_every_entry_in_order_of_keys(spark, monkeypatch):
    monkeypatch.setattr(bpe, "FLUSH", 7)
    want = {int(k): list(range(k % 5)) for k in np.random.default_rng(4).integers(-10 ** 18, 10 ** 18, 500)}
    keys, at, flat = bpe.lookup_arrays(spark.createDataFrame(list(want.items()), "key long, ids array<int>").repartition(3))
    assert keys.tolist() == sorted(want) and at.dtype == np.int32 and flat.dtype == np.uint16
    assert {int(k): flat[a:b].tolist() for k, a, b in zip(keys, at, at[1:])} == want


@pytest.mark.parametrize("room", [0, 200, 1 << 20])
def test_bpe_rare_words_and_white_space(spark, room):
    from tokenizers import Tokenizer
    t, rng = Tokenizer.from_file(bpe.tokenizer_path()), np.random.default_rng(3)
    parts = ["a", "The", "it's", "'re", "12", "...", " ", "  ", "\n", "\t", "\x85", " ", "　", "é", "日本", "😀", "<|endoftext|>", "ԱԲ", "՘"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 14)))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = bpe.encode(df, table_bytes=room, decoded=True)
    got = {r.doc_id: (list(r.ids), r.decoded) for r in coded.collect()}
    assert got == {r.doc_id: (list(r.ids), r.decoded) for r in bpe.decode(coded).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[i] == (ids, t.decode(ids, skip_special_tokens=False)), repr(text)


def test_chat_format(spark, none, tmp_path):
    rows = [(1, 1, "assistant", "Fine [/INST] \\ <s> ok</s>"), (1, 0, "user", "Hi\\n"), (2, 0, "assistant", None), (2, 0, "assistant", "b"),
            (None, None, None, "x"), (3, 5, "assistant", "é😀" * 50_000), (3, 4, "sys[/INST]tem", "<image> is no image"), (4, 0, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in rows_of(QUERIES["op4_chat_format"](spark, str(tmp_path)))}
    probe = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", probe), (-1, 1, "assistant", probe)]
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), brute.sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)))
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), brute.sha(loss))
    assert len(got) == 6 and len(rows_of(QUERIES["op4_chat_format"](spark, none))) == 1


def test_content_parts_become_placeholders_in_order(spark):
    parts = [("text", "See ", None, None, None, None, None), ("image", None, "s3://a.png", 28, 15, None, None), ("text", " <image> ", None, None, None, None, None),
             ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3), ("video", None, "d", None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = chat_format.read_back(chat_format.format_conversations(df)).first()
    assert "See <image> <\\image> <audio><document><part></s>" in r.formatted
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [
        ("image", "s3://a.png", 4), ("audio", "b.wav", 50), ("document", "c.pdf", 1536), ("video", "d", 1)]
    assert r.expanded_tokens == 1 + 4 + 1 + 50 + 1536 + 1 and r.turns[0].content == "See <image> <image> <audio><document><part>"


def test_jaccard_join(spark, docs, odd):
    got = by_id(rows_of(QUERIES["op5_jaccard_join"](spark, SF)))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == {d: c for (d, _), c in zip(docs, brute.components(docs))}
    texts = [r[:2] for r in ROWS]
    found = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(QUERIES["op5_jaccard_join"](spark, odd)))
    assert found == collections.Counter((d, *c) for (d, _), c in zip(texts, brute.components(texts)))


def test_jaccard_join_of_long_lists(spark, monkeypatch):
    """Small limits send every list through leaders, components and derived bounds."""
    for k, v in (("SHORT_LIST", 2), ("LONG", 4), ("LEADERS", 1), ("PARTNERS", 3), ("LOCAL_COUNT", 2)):
        monkeypatch.setattr(jaccard_join, k, v)
    rng, base, rows = np.random.default_rng(1), [f"w{i}" for i in range(80)], []
    for d in range(150):
        w = list(base)
        for k in rng.integers(0, 80, int(rng.integers(0, 4))):
            w[k] = f"x{rng.integers(0, 40)}"
        rows.append((d, " ".join(w[int(rng.integers(0, 9)):80 - int(rng.integers(0, 9))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == {d: c for (d, _), c in zip(rows, brute.components(rows))}


def check_mix(rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want = brute.targets(dict(sizes))
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    return want, taken


def test_mixing(spark, docs, odd):
    for sf, miss in ((SF, 0.2), ("/root/testdata/sf0.01", 0.015)):     # 10 and 50 documents a source
        source = {r.doc_id: (r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        got = [{**r, "source": source[r["doc_id"]][0]} for r in rows_of(QUERIES["op6_mixing"](spark, sf))]
        assert {r["doc_id"]: r["size"] for r in got} == {d: len(brute.words(t)) for d, (_, t) in source.items()}
        want, taken = check_mix(got)
        assert all(abs(want[s] - taken[s]) <= miss * want[s] for s in want)
    assert by_id(rows_of(QUERIES["op6_mixing"](spark, sf))) == {r["doc_id"]: {k: v for k, v in r.items() if k != "source"} for r in got}
    assert len(rows_of(QUERIES["op6_mixing"](spark, odd))) == len(ROWS)


def test_mixing_of_repeated_rows(spark, tmp_path):
    """A row a thousand times over: the boundary falls between its copies, and SQL gives the same rows."""
    import duckdb

    from hostwatch.llm.oracle_text import SQL
    same = " ".join(f"w{i}" for i in range(10))
    rows = [(1, same, "en", "b")] * 1000 + [(1, same, "en", None)] * 3 + [(i, f"{i} " * (3 + i % 9), "en", "a") for i in range(2, 400)]
    folder = write(spark, tmp_path, rows)
    got = QUERIES["op6_mixing"](spark, folder).collect()
    assert len(got) == len(rows)
    for source, size in (("b", 10_000), (None, 30)):
        own = [r for r in got if r.source_size == size]
        taken, target = sum(r.taken for r in own), own[0].target
        assert abs(taken - target) <= 10 and len({r.taken for r in own}) <= 2
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    cell = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert collections.Counter(map(cell, got)) == collections.Counter(map(cell, con.execute(SQL["op6_mixing"]).fetchall()))


def test_mix_targets_reshare_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 400, "é": 0, "z": 3}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute.targets(sizes))


def test_mixed_documents_keep_their_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() > 0


def test_tied_turns_are_ordered_by_their_text(spark):
    texts = ["<s>", "<a", "</s>", "[INST]", "z"]
    rows = [(1, 0, "user", t) for t in texts]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.read_back(chat_format.format_conversations(df.select(
        "conv_id", "turn", "role", chat_format.text_part(common.F.col("text")).alias("parts")))).first()
    assert [t["content"] for t in out.turns] == sorted(texts)


def check_lines(rows, texts):
    want = collections.Counter((d, n, gone, brute.sha(kept)) for (d, _), (kept, n, gone) in zip(texts, brute.kept_lines(texts)))
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows) == want


def test_line_dedup_of_very_many_lines(spark):
    """Texts of many lost lines; no run is left in the catalog."""
    lines = [f"shared line number {i} of the texts" for i in range(20_000)]
    text = "\n".join(lines)
    df = spark.createDataFrame([(d, text + f"\nown {d}") for d in (1, 2, 3)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_lines(df).collect()}
    assert got == {1: ("own 1", 20_000), 2: ("own 2", 20_000), 3: (text + "\nown 3", 0)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_dedup(spark, docs, odd):
    check_lines(rows_of(QUERIES["op7_line_dedup"](spark, SF)), docs)
    check_lines(rows_of(QUERIES["op7_line_dedup"](spark, odd)), [r[:2] for r in ROWS])


@pytest.mark.parametrize("batches", [1, 7])
def test_line_runs_compact_without_changing_the_result(spark, batches):
    line = "a line long enough to be a key"
    rows = [(d, "\n".join([line, f"own line number {d} of its document", line.upper() + " "] if d % 2 else [f"{line} {d % 5}"])) for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(df, batches=batches, fan=2).collect()}
    assert got == {d: x for (d, _), x in zip(rows, brute.kept_lines(rows))}


def base_scores(texts):
    tokens = [[*(w.encode() for w in brute.words((t or "").translate(brute.LOWER))), None] for _, t in texts]
    counts = collections.Counter(w for (d, _), own in zip(texts, tokens) if not brute.in_fold(d, 7) for w in own)
    n, v = sum(counts.values()), len(counts)
    return [(d, brute.in_fold(d, 7), len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 4))
            for (d, _), own in zip(texts, tokens)]


def scored(rows):
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    return collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows)


def test_lm_scoring(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows_of(QUERIES["op8_lm_scoring"](spark, sf))
    assert scored(got) == collections.Counter(base_scores(docs))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert sum(r["score"] > r["base_score"] for r in held) > 0.9 * len(held)
    assert scored(rows_of(QUERIES["op8_lm_scoring"](spark, odd))) == collections.Counter(base_scores([r[:2] for r in ROWS]))


def test_lm_base_score_of_rare_words(spark, docs):
    df = spark.createDataFrame(docs[:60], "doc_id long, text string")
    out = lm_scoring.score_documents(df, language_id.held_out(7), table_words=100)
    assert scored(rows_of(out)) == collections.Counter(base_scores(docs[:60]))


def test_lm_score_of_rare_words(spark, docs):
    df = spark.createDataFrame([*docs[:60], (2000, None), (2001, "unseen unseen word")], "doc_id long, text string")
    want, got = (by_id(rows_of(lm_scoring.score_documents(df, language_id.held_out(7), table_words=n))) for n in (lm_scoring.TABLE_WORDS, 100))
    assert got.keys() == want.keys()
    for d in want:
        assert got[d]["score"] == pytest.approx(want[d]["score"], rel=1e-6), d


def test_lm_training_windows_hold_every_subword(spark, docs):
    df = spark.createDataFrame([*docs[:20], (1000, LONG), (1001, None), (1002, "")], "doc_id long, text string")
    got = lm_scoring.count_corpus(df, bpe.tokenizer_path()).collect()
    windows = [r.ids for r in got if r.kind == "window"]
    assert max(map(len, windows)) == lm_scoring.WINDOW + 1 and min(map(len, windows)) == 2
    pieces = collections.Counter()
    for r in got:
        if r.kind == "piece":
            pieces[r.key] += r.n
    assert collections.Counter(i for w in windows for i in w[1:]) == pieces


def test_lm_counting_encodes_few_words_at_once_and_gives_memory_back(spark, monkeypatch):
    """Encoded words take much room until their ids are read; a worker that stays must not keep it."""
    class Tokenizer:
        most = 0

        def encode_batch(self, texts, add_special_tokens):
            self.most = max(self.most, len(texts))
            return [type("Encoded", (), {"ids": [ord(x) for x in t]}) for t in texts]

    words, pieces = lm_scoring.Words(), lm_scoring.Pieces(bpe.tokenizer_path())
    words.of(" ".join(f"w{i}" for i in range(20_000)))
    pieces.tokenizer = Tokenizer()
    pieces.grow(words)
    assert pieces.tokenizer.most <= lm_scoring.TOGETHER < 20_000 and len(pieces.start) == len(words) + 1
    assert pieces.of(np.array([20_000]))[0].tolist() == [ord(x) for x in " w19999"]

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, function, schema):  # noqa: N802
            return function

    released = []
    monkeypatch.setattr(common, "release_memory", lambda: released.append(1))
    rows = list(lm_scoring.count_corpus(Docs(), bpe.tokenizer_path())(iter([pa.RecordBatch.from_pydict(
        {"doc_id": list(range(600)), "text": ["some words"] * 600})])))
    assert released == [1] and sum(r.num_rows for r in rows if r.column("kind")[0].as_py() == "window") == 600


def test_lm_round_is_one_pass(spark, docs):
    df = spark.createDataFrame(docs[:20], "doc_id long, text string")
    path = bpe.tokenizer_path()
    got = lm_scoring.count_corpus(df, path).cache()
    counts = {r.key: r.n for r in got.filter("kind = 'piece'").groupBy("key").sum("n").toDF("key", "n").collect()}
    layout = lm_scoring.Layout(counts, lm_scoring.word_beginnings(path), lm_scoring.end_id(path))
    windows = got.filter("kind = 'window'").select("ids", "key")
    own = lm_scoring.padded(windows.orderBy("key", "ids").toArrow().column("ids").combine_chunks(), layout)
    want = lm_scoring.train(lm_scoring.as_floats(lm_scoring.new_weights(layout)), layout, own, lm_scoring.RATE)
    fitted = lm_scoring.fit(windows, layout, 1)
    assert all(np.allclose(fitted[k], want[k], atol=1e-4) for k in want)


def test_lm_gradients_and_window_plan():
    begins = np.zeros(50257, bool)
    begins[:20] = True
    layout = lm_scoring.Layout({i: 5 + i for i in range(40)}, begins, 50256)
    w = {k: v.astype(np.float64) for k, v in lm_scoring.new_weights(layout).items()}
    ids = np.random.default_rng(0).integers(0, layout.size, (3, 9))
    ids[2, 6:] = -1

    def loss(w):
        h, _ = lm_scoring.attend(w, np.maximum(ids[:, :-1], 0))
        real = ids[:, 1:] >= 0
        return -lm_scoring.log_chances(w, layout, h[real], ids[:, 1:][real])[0].mean()

    g = lm_scoring.gradients(w, layout, ids)
    for name, at in (("e", (3, 2)), ("q", (1, 2)), ("k", (4, 5)), ("v", (0, 7)), ("o", (2, 2)), ("w1", (1, 9)), ("w2", (5, 3)), ("wc", (2, 1)), ("m", (1, 2, 4)), ("p", (1, 1))):
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert g[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=2e-4), name
    h = np.random.default_rng(1).normal(0, 1, (1, lm_scoring.WIDTH))
    every = np.arange(layout.size)
    logs, begin = lm_scoring.log_chances(w, layout, np.repeat(h, layout.size, 0), every)
    assert np.exp(logs).sum() == pytest.approx(1) and np.exp(logs[layout.first]).sum() == pytest.approx(np.exp(begin[0]))
    for n in (1, 31, 32, 33, 60, 61, 200):
        row, low, first = lm_scoring.window_plan(np.array([n]))
        seen = [i for a, b in zip(low, first) for i in range(b, min(a + lm_scoring.WINDOW, n))]
        assert seen == list(range(n))


def check_copies(rows, texts):
    norm = ["".join(c for c in (t or "") if c not in brute.SPACES) for _, t in texts]
    best, size = {}, collections.Counter(norm)
    for (d, t), n in zip(texts, norm):
        key = (-len(t or ""), math.inf if d is None else d)
        best[n] = min(best.get(n, (key, d)), (key, d), key=lambda x: x[0])
    want = collections.Counter((d, best[n][1], size[n], brute.sha(n)) for (d, _), n in zip(texts, norm))
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == want
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(size) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup(spark, docs, odd):
    check_copies(rows_of(QUERIES["op9_exact_dedup"](spark, SF)), docs)
    check_copies(rows_of(QUERIES["op9_exact_dedup"](spark, odd)), [r[:2] for r in ROWS])


def test_exact_dedup_parts_texts_whose_digests_collide(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text", "_metadata")
    weak = lambda text: (common.F.octet_length(text) % 3).cast("string").cast("binary")
    out = exact_dedup.deduplicate(docs, digest=weak, batch_bytes=1000)
    out = out.select("doc_id", "keep_id", "group_size", "kept").collect()
    norm = collections.Counter("".join(c for c in (t or "") if c not in brute.SPACES) for _, t, *_ in ROWS)
    assert sorted(r.group_size for r in out) == sorted(n for n in norm.values() for _ in range(n)) and sum(r.kept for r in out) == len(norm)


def test_exact_dedup_resumes_after_a_stop(spark, tmp_path):
    """A second run on the same checkpoint reads new files alone and goes on from the state on disk."""
    prints, checkpoint = str(tmp_path / "prints"), str(tmp_path / "state")

    def add(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        exact_dedup.fingerprints(df, common.F.struct(common.F.lit("f").alias("file"), common.F.col("doc_id").alias("row"))).write.mode("append").parquet(prints)

    def run():
        schema = spark.read.parquet(prints).schema
        exact_dedup.run_stream(spark.readStream.schema(schema).parquet(prints), checkpoint)
        return sorted((r.group_size, -r.keep.minus_id) for r in exact_dedup.state_table(spark, checkpoint).collect())

    add([(7, "same text"), (3, "same text"), (5, "other")])
    assert run() == [(1, 5), (2, 3)]
    assert run() == [(1, 5), (2, 3)]
    add([(2, "sametext"), (9, "same  text"), (1, "new")])
    assert run() == [(1, 1), (1, 5), (4, 9)]


@pytest.mark.parametrize("odd_rows", [False, True])
def test_language_id_against_plain_ranks(spark, odd, odd_rows):
    sf = odd if odd_rows else SF
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute.languages(rows, language_id.PROFILE, lambda d: brute.in_fold(d, 4))
    for r in rows_of(QUERIES["op10_language_id"](spark, sf)):
        if r["doc_id"] is not None:             # two odd rows have no id
            assert r["lang_pred"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1]), r


def test_language_id(spark, odd):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows_of(QUERIES["op10_language_id"](spark, sf))
    assert all(r["held_out"] == brute.in_fold(r["doc_id"], 4) and 0 <= r["score"] <= 1 for r in got) and len(got) == len(lang)
    held = [r for r in got if r["held_out"] and any(c.isalpha() for c in lang[r["doc_id"]][1])]
    assert sum(r["lang_pred"] == lang[r["doc_id"]][0] for r in held) >= 0.97 * len(held)
    found = rows_of(QUERIES["op10_language_id"](spark, odd))
    assert len(found) == len(ROWS)
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} >= {2, 3, 4, 9}


def test_language_id_ties_and_places():
    ranker = language_id.Ranker({"b": np.array([98, 97], np.uint64), "a": np.array([97, 98], np.uint64)}, 2)
    letters = language_id.letter_table()
    assert ranker.predict("b b b a a", letters)[0] == "b" and ranker.predict("zz", letters)[0] == "a" and ranker.predict("1 2", letters) == ("und", 0.0)

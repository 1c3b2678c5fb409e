"""BPE encoding and decoding through a table of distinct words.

Texts are split into words by the split pattern of byte-level BPE, in tasks. The distinct words of the whole corpus,
with their counts, form a table; each word is encoded once there. A document's ids are the ids of its words in their
positions. Decoding joins ids to the byte pieces of the vocabulary (a fixed, small table) and concatenates them.

Word table by size: the most frequent words whose table stays within ``table_bytes`` go to all tasks, where one
lookup per distinct word of a batch replaces a shuffle of every word of the corpus. The other words are rare; their
occurrences are joined to the table by word with a shuffle and put back by position. Both ways give the same ids.

Splitting: a blank between two characters that are no white space always begins a word and no word goes past it, so
such texts are cut at blanks and each distinct part is split once in a task; parts of letters or digits alone are words
as they are. Texts with other white space beside a blank are split whole. Texts that hold a special token, or characters
outside ranges on which the pattern is known to agree with the tokenizers library, are split by the library itself.
Short words without such characters are encoded by tiktoken with the file's vocabulary, which gives the same ids; all
others by the library.

Null text is empty: no ids, decoded as an empty text. Very long texts are one row like any other. Columns of the
names ``ids`` and ``decoded`` give way.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The split pattern of byte-level BPE, and the characters on which two implementations of it agree.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ODD = r"[^\x00-\u0557\u2010-\u202E\u2030-\u205E\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3]"
FLUSH = 80_000
#: Most characters of a word that tiktoken encodes.
SHORT = 32
ROWS = 256
TABLE_BYTES = 192 << 20


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Vocabulary:
    """Pieces and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        of = byte_characters()
        pieces = {i: bytes(of[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces.update({i: s.encode() for s, i in self.special.items()})
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]


def split_by_library(tokenizer, special: list[str], text: str) -> list[str]:
    """Words of one text as the library splits it; special tokens are words of their own."""
    cut = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text) if special else [text]
    words: list[str] = []
    for part in cut:
        if part in special:
            words.append(part)
        else:
            words.extend(part[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(part))
    return words


class Numbering(dict):
    """Numbers parts of texts as they come, in one list for several dictionaries."""

    def __init__(self, parts: list[str], before: str):
        super().__init__()
        self.parts, self.before = parts, before

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self.parts)
        self.parts.append(self.before + part)
        return number


class Splitter:
    """Cuts texts into numbered parts, and parts into words; each distinct part is split once."""

    def __init__(self, path: str, special: list[str]):
        import regex
        self.path, self.special, self.tokenizer = path, special, None
        self.pattern, self.odd, self.wide = regex.compile(SPLIT), regex.compile(ODD), regex.compile(r" \s|\s ")
        self.rare_space = re.compile(r"[^\S \n]")
        self.parts: list[str] = []
        self.after_blank, self.exact, self.whole = Numbering(self.parts, " "), Numbering(self.parts, ""), set()

    def numbers(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int64)
        if not text.isascii() and self.odd.search(text) or any(t in text for t in self.special):
            if self.tokenizer is None:
                from tokenizers import Tokenizer
                self.tokenizer = Tokenizer.from_file(self.path)
            words = split_by_library(self.tokenizer, self.special, text)
            self.whole.update(words)
        elif "  " in text or " \n" in text or "\n " in text or self.rare_space.search(text) and self.wide.search(text):
            words = self.pattern.findall(text)
        else:
            first, *rest = text.split(" ")
            out = np.fromiter(map(self.after_blank.__getitem__, rest), np.int64, len(rest))
            return np.insert(out, 0, self.exact[first]) if first else out
        return np.fromiter(map(self.exact.__getitem__, words), np.int64, len(words))

    def words(self, low: int) -> Iterator[list[str]]:
        """Words of each part from number ``low`` on."""
        for part in self.parts[low:]:
            bare = part[1:] if part[:1] == " " else part
            yield [part] if bare.isalpha() or bare.isdecimal() or part in self.whole else self.pattern.findall(part)


class Encoder:
    """Ids of words: of short ones by tiktoken, of odd and long ones and special tokens by the file's library."""

    def __init__(self, path: str, special: dict[str, int]):
        import regex
        import tiktoken
        from tokenizers import Tokenizer
        self.special, self.odd, self.library = special, regex.compile(ODD), Tokenizer.from_file(path)
        others = set(special.values())
        # ids follow the order of the merges
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, special_tokens={}, mergeable_ranks={
            piece: i for i, piece in enumerate(Vocabulary(path).pieces) if i not in others})

    def ids(self, entries: list[str]) -> list[list[int]]:
        out = [None if len(w) > SHORT or w in self.special or not w.isascii() and self.odd.search(w) else self.fast.encode_ordinary(w)
               for w in entries]
        slow = [k for k, ids in enumerate(out) if ids is None]
        for k, coded in zip(slow, self.library.encode_batch([entries[k] for k in slow], add_special_tokens=False) if slow else []):
            out[k] = [self.special[entries[k]]] if entries[k] in self.special else coded.ids
        return out


def word_table(docs: DataFrame, path: str, special: dict[str, int]) -> DataFrame:
    """word, n, ids: every distinct word of all texts, encoded once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, totals = Splitter(path, list(special)), np.zeros(0, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                found = np.concatenate([splitter.numbers(t) for t in batch.column("text").slice(low, ROWS).to_pylist()])
                own = np.bincount(found, minlength=len(splitter.parts))
                own[:len(totals)] += totals
                totals = own
                if len(splitter.parts) > FLUSH:
                    yield counted(splitter, totals)
                    splitter, totals = Splitter(path, list(special)), np.zeros(0, np.int64)
        yield counted(splitter, totals)

    def counted(splitter: Splitter, totals: np.ndarray) -> pa.RecordBatch:
        n: dict[str, int] = {}
        for words, times in zip(splitter.words(0), totals.tolist()):
            for word in words:
                n[word] = n.get(word, 0) + times
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(path, special)
            ids = encoder.ids(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.list_(pa.int32()))],
                                             ["word", "n", "ids"])

    counts = docs.select("text").mapInArrow(common.releasing(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    coded = common.staged(counts.mapInArrow(common.releasing(encode), "word string, n long, ids array<int>"), "words")
    return coded.withColumn("key", F.xxhash64("word"))


def frequent_words(table: DataFrame, table_bytes: int) -> tuple[DataFrame, bool]:
    """The most frequent words within ``table_bytes``, and whether these are all. Words that share a key are left out."""
    cost = 12 + 4 * F.size("ids")
    whole, words, keys = table.agg(F.sum(cost), F.count(F.lit(1)), F.count_distinct("key")).first()
    if words > keys:
        shared = table.groupBy("key").count().filter("count > 1")
        table = table.join(F.broadcast(shared) if words - keys < 1000 else shared, "key", "left_anti")
    if (whole or 0) <= table_bytes:
        return table, words == keys
    # counts by powers of 1.25: about a hundred rows
    step = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    by_count = table.groupBy(step.alias("step")).agg(F.sum(cost).alias("bytes")).collect()
    room, least = table_bytes, 1 << 30
    for row in sorted(by_count, key=lambda r: -r["step"]):
        room -= row["bytes"]
        if room < 0:
            break
        least = row["step"]
    return table.filter(step >= least), False


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all spans, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def offsets_of(lists: pa.Array) -> np.ndarray:
    return lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)


def int_lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Arrow's lists of arrays, without a step through Python for each number."""
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *rows]), pa.int32()))


def encode(docs: DataFrame, path: str | None = None, table_bytes: int = TABLE_BYTES, decoded: bool = False) -> DataFrame:
    """``docs`` without text, with ``ids``; with ``decoded`` also the text that they decode to.

    Decoding in the same tasks spares a second Python worker for each; rows with rare words are decoded afterwards.
    """
    common.bounded_batches(docs.sparkSession)
    path = path or tokenizer_path()
    vocabulary = Vocabulary(path)
    special, others = vocabulary.special, [c for c in docs.columns if c not in ("text", "ids", *(["decoded"] if decoded else []))]
    table = word_table(docs, path, special)
    frequent, complete = frequent_words(table, table_bytes)
    sent = docs.sparkSession.sparkContext.broadcast(lookup_arrays(frequent))
    common.release_memory()
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, at, flat = sent.value
        parts, pieces = None, Pieces(vocabulary.pieces) if decoded and complete else None
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                if parts is None or len(parts.splitter.parts) > FLUSH:
                    parts = PartIds(Splitter(path, list(special)), keys, at, flat)
                own = batch.slice(low, ROWS)
                found = [parts.splitter.numbers(t) for t in own.column("text").to_pylist()]
                parts.grow()
                ids, rare = zip(*(parts.of(x) for x in found))
                arrays = [*[own.column(c) for c in others], int_lists(ids)]
                if pieces:
                    arrays.append(pa.array(map(pieces.text, ids), pa.string()))
                elif not complete:
                    arrays.append(pa.array(rare, pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    extra = {"decoded": "string"} if decoded and complete else {} if complete else {"rare_": "array<string>"}
    names = [*others, "ids", *extra]
    out = docs.select(*others, "text").mapInArrow(common.releasing(look_up), f"{fields}ids array<int>" + "".join(f", {k} {v}" for k, v in extra.items()))
    if complete:
        return out
    return decode(put_back(out, table), path) if decoded else put_back(out, table)


def put_back(partial: DataFrame, table: DataFrame) -> DataFrame:
    """Join the rare words of every row to the table by word and put their ids back by position."""
    partial = common.staged(partial.withColumn("key_", F.monotonically_increasing_id()), "bpe-partial")
    rare = partial.select("key_", F.posexplode("rare_").alias("pos", "word")).join(table.select("word", F.col("ids").alias("own")), "word")
    rare = rare.groupBy("key_").agg(F.array_sort(F.collect_list(F.struct("pos", "own"))).alias("found_"))
    out = partial.join(rare, "key_", "left")
    ids = F.flatten(F.transform("ids", lambda x: F.when(x < 0, F.element_at(F.col("found_"), -x)["own"]).otherwise(F.array(x))))
    return out.withColumn("ids", F.when(F.col("found_").isNull(), F.col("ids")).otherwise(ids)).drop("key_", "rare_", "found_")


def lookup_arrays(frequent: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted word hashes, where the ids of each begin (and the last end), and all ids."""
    found = frequent.select("key", "ids").toArrow()
    keys, length, flat = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.uint16)]
    for batch in found.to_batches():
        lists, ids = batch.column("ids"), batch.column("ids").flatten().to_numpy()
        keys.append(batch.column("key").to_numpy())
        length.append(np.diff(offsets_of(lists)).astype(np.int32))
        flat.append(ids.astype(np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.int32))
    del found
    keys, length, flat = (np.concatenate(x) for x in (keys, length, flat))
    order = np.argsort(keys)
    keys = keys[order]
    start = np.cumsum(length, dtype=np.int64) - length
    # the table's bytes are bounded, and with them the number of ids
    at, out = np.concatenate(([0], np.cumsum(length[order]))).astype(np.int32), np.empty_like(flat)
    for low in range(0, len(order), FLUSH):     # indices of some entries at once take less room than those of all
        own = order[low:low + FLUSH]
        out[at[low]:at[low + len(own)]] = flat[spans(start[own], length[own])]
    return keys, at, out


def word_key(word: str) -> int:
    """The key that the word table has from Spark's xxhash64."""
    import xxhash
    value = xxhash.xxh64_intdigest(word.encode("utf-8"), 42)
    return value - (1 << 64) if value >> 63 else value


class PartIds:
    """Ids of all numbered parts, looked up once for each part; words without a key are named by negative numbers."""

    def __init__(self, splitter: Splitter, keys: np.ndarray, at: np.ndarray, flat: np.ndarray):
        self.splitter, self.keys, self.at, self.flat = splitter, keys, at, flat
        self.lost: list[str] = []
        self.ids, self.start = np.empty(0, np.int32), np.zeros(1, np.int64)

    def grow(self) -> None:
        sizes, words = [], []
        for own in self.splitter.words(len(self.start) - 1):
            sizes.append(len(own))
            words.extend(own)
        if not sizes:
            return
        own = np.fromiter(map(word_key, words), np.int64, len(words))
        place = np.minimum(np.searchsorted(self.keys, own), max(0, len(self.keys) - 1))
        missing = self.keys[place] != own if len(self.keys) else np.ones(len(own), bool)
        place[missing] = 0
        begin = np.where(missing, 0, self.at[place])
        length = np.where(missing, 1, self.at[place + 1] - self.at[place]) if len(self.keys) else np.ones(len(own), np.int64)
        ends = np.cumsum(length)
        more = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        known = np.repeat(~missing, length)
        more[known] = self.flat[spans(begin[~missing], length[~missing])]
        more[~known] = -np.arange(len(self.lost) + 1, len(self.lost) + 1 + int(missing.sum()))
        self.lost.extend(w for w, gone in zip(words, missing) if gone)
        count = np.cumsum(sizes)
        self.start = np.concatenate((self.start, self.start[-1] + np.concatenate(([0], ends))[count]))
        self.ids = np.concatenate((self.ids, more))

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Ids of a text; its missing words in order, each numbered down from -1 in the ids."""
        ids = self.ids[spans(self.start[numbers], self.start[numbers + 1] - self.start[numbers])]
        gone = ids < 0
        if not self.lost or not gone.any():
            return ids, []
        rare = [self.lost[-i - 1] for i in ids[gone].tolist()]
        ids[gone] = -np.arange(1, len(rare) + 1)
        return ids, rare


class Pieces:
    """The byte pieces of all ids, in one array: ids are joined to their pieces by place."""

    def __init__(self, pieces: list[bytes]):
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def text(self, ids: np.ndarray) -> str:
        return self.data[spans(self.start[ids], self.length[ids])].tobytes().decode("utf-8", "replace")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``coded`` with ``decoded``: the pieces of its ids, joined by id and concatenated."""
    common.bounded_batches(coded.sparkSession)
    pieces = Vocabulary(path or tokenizer_path()).pieces
    others = [c for c in coded.columns if c != "decoded"]
    fields = "".join(f"`{c}` {coded.schema[c].dataType.simpleString()}, " for c in others)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(pieces)
        for batch in batches:
            column = batch.column("ids")
            ids, at = column.flatten().to_numpy(), offsets_of(column)
            texts = pa.array((table.text(ids[a:b]) for a, b in zip(at[:-1], at[1:])), pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], texts], [*others, "decoded"])

    return coded.mapInArrow(common.releasing(joined), f"{fields}decoded string")


def digests(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    """``docs`` without text, with n_tokens, ids_sha256 and decoded_sha256 (and ids)."""
    added = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    names = [c for c in docs.columns if c != "text" and c not in added]
    out = encode(docs.select(*names, "text"), decoded=True)
    return out.select(*names, F.size("ids").cast("long").alias("n_tokens"), *(["ids"] if keep_ids else []),
                      F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "utf-8"), 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return digests(common.documents(spark, sf_dir).select("doc_id", "text"))

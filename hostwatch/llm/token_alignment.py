"""Alignment of two tokenizers by the byte offsets at which both end a token.

Tokenizer A is byte-level BPE, B has pieces with byte fallback and puts a blank before the text; both encode blank + text.
Common ends are found by galloping intersection: the shorter list of ends drives, and every end of it is searched in
the longer list by doubling steps from the last place and then by halves. The common places slice both id lists into
groups; the differences of their ranks are the ranges that overlap, so a group of m and n ids has m * n links. New parts of
texts are laid end to end, so one search runs through the ends of many parts; all else is array arithmetic.

Parts. A blank between two characters that are no white space ends a token of both tokenizers, so a text is cut there and
every distinct part of a block of documents is encoded and aligned once; other texts (white space beside a blank, a blank
at the end, U+2581) are one part. A block is as many whole documents as have ``PARTS`` distinct parts or ``CHARS``
characters of them. It is written as one row: ids of its parts per document, links per part as places in a list of the block's
distinct pairs, and in how many of its documents each pair is linked.

Counts of id pairs are summed over all blocks. A pair that the whole corpus links in one document only needs no count
in any table: what is absent counts 1. The others go to all tasks if there are at most ``TABLE_PAIRS`` of them, else
blocks are joined with them by pair. Both ways give the same result. The highest count of an A id is kept for every id of
the vocabulary.

Null and empty texts, and those whose joined bytes differ from blank + text, have no tokens: zeros and an empty digest, and no
link counts. Strings of special tokens are ordinary text. Repeated rows are documents of their own, each counts. A very long
text is a block by itself at most. Links within a large group are counted by distinct pair with a multiplicity, never listed one
by one. Input columns with the names of results give way.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import SPLIT, Numbering, Pieces, byte_characters, spans

PARTS, CHARS, ROWS, TOGETHER = 90_000, 6_000_000, 128, 64
TABLE_PAIRS = 12_000_000
#: Runs of white space as long as this go to the library of the file's own format: the faster one cannot match very long ones.
RUN = 2000
#: Groups with more links than this are listed by distinct ids.
LISTED = 64
#: Marks a text that is one part: no part of another text begins with a blank.
LONE = " "
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
#: Fixed value: how B writes a blank.
MARK = "▁"
WHOLE = rf" [\s\u180e]|[\s\u180e] | $|{MARK}"


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def gallop(short: list[int], long: list[int]) -> tuple[list[int], list[int]]:
    """Places of the values that both ascending lists hold."""
    at, n, mine, theirs = 0, len(long), [], []
    for place, value in enumerate(short):
        if at == n:
            break
        if long[at] < value:
            step, high = 1, at
            while high < n and long[high] < value:
                at, high, step = high + 1, high + step, 2 * step
            at = bisect_left(long, value, at, min(high, n))
            if at == n:
                break
        if long[at] == value:
            mine.append(place)
            theirs.append(at)
            at += 1
    return mine, theirs


def common_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places in ``a`` and in ``b`` of their common ends; the shorter list drives."""
    if len(a) <= len(b):
        return gallop(a, b)
    there, here = gallop(b, a)
    return here, there


class Tokenizers:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import regex
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.slow, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.slow.encode_special_tokens = True
        self.slow.no_truncation()
        self.slow.no_padding()
        spec = self.slow
        of = byte_characters()
        self.bytes_a = [bytes(of.get(c, 63) for c in spec.id_to_token(i) or "") for i in range(spec.get_vocab_size())]
        special = spec.get_added_tokens_decoder()
        self.run = regex.compile(rf"\s{{{RUN}}}")
        # the file's vocabulary, run by the library that takes least time for it; ids follow the order of the merges
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, special_tokens={}, mergeable_ranks={
            x: i for i, x in enumerate(self.bytes_a) if i not in special})
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode("utf-8"))
        self.pieces_a, self.pieces_b = Pieces(self.bytes_a), Pieces(self.bytes_b)
        # ids in decimal with room for the sign behind each
        self.shown = Pieces([f"{i},".encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))])

    def ids_a(self, text: str) -> list[int]:
        if len(text) > RUN and self.run.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.a.encode_ordinary(text)

    def encode(self, parts: list[str], whole: list[bool] | None = None) -> "Aligned":
        """Both tokenizers' ids of blank + part, aligned. Parts that are no whole texts are encoded ``TOGETHER`` at a time."""
        texts, sizes, low = [], [], 0
        alone = whole or [True] * len(parts)
        for i in range(len(parts) + 1):
            if i == len(parts) or alone[i] or i - low == TOGETHER:
                if i > low:
                    texts.append(" ".join(parts[low:i]))
                    sizes.append(i - low)
                low = i
                if i < len(parts) and alone[i]:
                    texts.append(parts[i])
                    sizes.append(1)
                    low = i + 1
        data = [b" " + p.encode("utf-8") for p in parts]
        return Aligned(self, data, texts, sizes)


def flat_ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and how many each list has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


class Aligned:
    """Many parts aligned at once, as if they were one text: groups by their first ids, links and digits by part."""

    def __init__(self, tokenizers: Tokenizers, data: list[bytes], texts: list[str], sizes: list[int]):
        number = np.array(sizes, np.int64)
        of_a, of_b = [tokenizers.ids_a(" " + t) for t in texts], tokenizers.b.encode(texts, num_threads=1)
        bytes_of = np.fromiter(map(len, data), np.int64, len(data))
        good = self._same(tokenizers, [b" " + t.encode("utf-8") for t in texts], of_a, of_b)
        self.good = np.repeat(good, number)
        if not good.all():
            of_a, of_b = ([x if ok else [] for x, ok in zip(ids, good.tolist())] for ids in (of_a, of_b))
        self.a, self.b = flat_ids(of_a)[0], flat_ids(of_b)[0]
        ends_a, ends_b = np.cumsum(tokenizers.pieces_a.length[self.a]), np.cumsum(tokenizers.pieces_b.length[self.b])
        places = common_ends(ends_a.tolist(), ends_b.tolist())
        last_a, last_b = (np.array(x, np.int64) for x in places)
        self.ends = ends_a[last_a]
        self.size_a, self.size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        self.first_a, self.first_b = last_a + 1 - self.size_a, last_b + 1 - self.size_b
        part_ends = np.cumsum(np.where(self.good, bytes_of, 0))
        self.part = np.searchsorted(part_ends, self.ends)
        # a part without bytes ends where the one before does
        self.n_a, self.n_b = (np.bincount(self.part, s, len(data)).astype(np.int64) for s in (self.size_a, self.size_b))
        self.n_groups = np.bincount(self.part, minlength=len(data))
        links = self.size_a * self.size_b
        total = np.concatenate(([0], np.cumsum(links)))
        upto = np.concatenate(([0], np.cumsum(self.n_groups)))
        self.n_links = total[upto[1:]] - total[upto[:-1]]
        self.links = links
        self.pieces = tokenizers.shown

    @staticmethod
    def _same(tokenizers: Tokenizers, data: list[bytes], of_a: list[list[int]], of_b: list[list[int]]) -> np.ndarray:
        """Whether the joined bytes of both are those of each text."""
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        want, starts = np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes
        good = np.ones(len(data), bool)
        for ids, pieces, pieces_of in ((of_a, tokenizers.pieces_a, tokenizers.bytes_a), (of_b, tokenizers.pieces_b, tokenizers.bytes_b)):
            flat, number = flat_ids(ids)
            found = differences(pieces.length[flat], number)
            good &= found == sizes
            if good.all():
                same = pieces.data[spans(pieces.start[flat], pieces.length[flat])] == want
                if not same.all():
                    good &= np.logical_and.reduceat(same, starts)
            else:                                  # lengths differ somewhere: part by part
                texts = (b"".join(pieces_of[i] for i in x) for x in ids)
                good &= np.fromiter((x == d for x, d in zip(texts, data)), bool, len(data))
        return good

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked id pairs: part, key and how many links; small groups link by link, large ones by distinct pair."""
        small = np.flatnonzero(self.links <= LISTED)
        of = np.repeat(small, self.links[small])
        within = np.arange(len(of)) - np.repeat(np.cumsum(self.links[small]) - self.links[small], self.links[small])
        x, y = np.divmod(within, self.size_b[of])
        part, key = self.part[of], self.a[self.first_a[of] + x] << 16 | self.b[self.first_b[of] + y]
        times = np.ones(len(key), np.int64)
        large = np.flatnonzero(self.links > LISTED)
        if not len(large):
            return part, key, times
        parts, keys, counts = [part], [key], [times]
        for g in large.tolist():
            (ids_a, m), (ids_b, n) = (np.unique(ids[first:first + size], return_counts=True) for ids, first, size in (
                (self.a, self.first_a[g], self.size_a[g]), (self.b, self.first_b[g], self.size_b[g])))
            keys.append((ids_a[:, None] << 16 | ids_b).ravel())
            counts.append((m[:, None] * n).ravel())
            parts.append(np.full(len(keys[-1]), self.part[g]))
        part, key, times = (np.concatenate(c) for c in (parts, keys, counts))
        order = np.argsort(part, kind="stable")
        return part[order], key[order], times[order]

    def digits(self) -> list[bytes]:
        """Ids of each part as ``a1,a2|b1;a3|b2,b3;``."""
        count = len(self.a) + len(self.b)
        ids, sign = np.empty(count, np.int64), np.full(count, ord(","), np.uint8)
        group_a, group_b = (np.repeat(np.arange(len(self.links)), s) for s in (self.size_a, self.size_b))
        at_a = np.arange(len(self.a)) + self.first_b[group_a]
        at_b = np.arange(len(self.b)) + (self.first_a + self.size_a)[group_b]
        ids[at_a], ids[at_b] = self.a, self.b
        sign[at_a[self.first_a + self.size_a - 1]] = ord("|")
        sign[at_b[self.first_b + self.size_b - 1]] = ord(";")
        size = self.pieces.length[ids]
        out = self.pieces.data[spans(self.pieces.start[ids], size)]
        ends = np.cumsum(size)
        out[ends - 1] = sign
        shown, cuts = out.tobytes(), np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))].tolist()
        return [shown[i:j] for i, j in zip(cuts[:-1], cuts[1:])]


def cut(text: str, whole) -> list[str]:
    """Parts of a text, without the blank before each; a text that is one part bears a mark in front."""
    return [LONE + text] if whole.search(" " + text) else text.split(" ")


class Block:
    """Distinct parts of some documents, aligned once each, and the documents as part numbers."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers, self.parts, self.chars, self.done = tokenizers, [], 0, 0
        self.number = Numbering(self.parts, "")
        self.by_part: dict[str, list[np.ndarray]] = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "pairs", "key", "times")}
        self.shown: list[bytes] = []
        self.bad: set[int] = set()
        self.rows: list[pa.Array] = []
        self.docs: list[np.ndarray] = []
        self.digests: list[str] = []

    def align_parts(self) -> None:
        new = self.parts[self.done:]
        if not new:
            return
        self.chars += sum(map(len, new))
        lone = [p[:1] == LONE for p in new]
        found = self.tokenizers.encode([p[1:] if x else p for p, x in zip(new, lone)], lone)
        self.bad.update((np.flatnonzero(~found.good) + self.done).tolist())
        part, key, times = found.pairs()
        for c, values in (("n_a", found.n_a), ("n_b", found.n_b), ("n_groups", found.n_groups), ("n_links", found.n_links),
                          ("pairs", np.bincount(part, minlength=len(new))), ("key", key), ("times", times)):
            self.by_part[c].append(values.astype(np.int64))
        self.shown.extend(found.digits())
        self.done = len(self.parts)

    def values(self, column: str) -> np.ndarray:
        return np.concatenate(self.by_part[column]) if self.by_part[column] else np.empty(0, np.int64)

    def add(self, texts: list[str | None], rows: pa.Array, whole) -> None:
        numbers = [[self.number[p] for p in cut(t, whole)] if t else [] for t in texts]
        self.align_parts()
        for own in numbers:
            if self.bad and not self.bad.isdisjoint(own):
                own = []
            self.docs.append(np.array(own, np.int32))
            # the last part ends with a sign between groups, which the whole does not have
            self.digests.append(hashlib.sha256(b"".join([self.shown[i] for i in own])[:-1]).hexdigest() if own else "")
        self.rows.append(rows)

    def full(self) -> bool:
        return self.done >= PARTS or self.chars >= CHARS

    def row(self, name: str) -> pa.RecordBatch:
        """The block as one row."""
        keys, place = np.unique(self.values("key"), return_inverse=True)
        size = self.values("pairs")
        at = np.cumsum(size) - size
        held, scratch = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for own in self.docs:
            own = np.unique(own)
            linked = place[spans(at[own], size[own])]
            scratch[linked] = order = np.arange(len(linked))
            held[linked[scratch[linked] == order]] += 1
        lengths = np.array([len(d) for d in self.docs], np.int64)
        flat = np.concatenate(self.docs) if len(self.docs) else np.empty(0, np.int32)
        lists = {"rows": pa.concat_arrays(self.rows), "digests": pa.array(self.digests, pa.string()), "lengths": lengths, "numbers": flat,
                 **{c: differences(self.values(c)[flat], lengths) for c in ("n_a", "n_b", "n_groups", "n_links")},
                 "pairs": size.astype(np.int32), "places": place.astype(np.int32), "times": self.values("times"), "keys": keys}
        columns = []
        for values in lists.values():
            values = values if isinstance(values, pa.Array) else pa.array(values)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        whole = pa.RecordBatch.from_arrays(columns, list(lists))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(whole)
        # the body is one value to Spark's readers, which would hold lists of so many numbers several times over
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), whole.column("keys"),
             pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.array(held))], ["block", "body", "keys", "held"])


def read_body(body: bytes):
    """Access to the lists of a block by name."""
    whole = pa.ipc.open_stream(body).read_next_batch()
    return lambda c: whole.column(c).flatten()


def differences(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def blocks(docs: DataFrame, keep: list[str], paths: tuple[str, str]) -> DataFrame:
    """All documents as blocks, staged. A task makes a block after the other and holds one at a time."""
    schema = "block string, body binary, keys array<long>, held array<long>"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        whole, tokenizers, made, block = regex.compile(WHOLE), None, 0, None
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                own = batch.slice(low, ROWS)
                tokenizers = tokenizers or Tokenizers(*paths)
                block = block or Block(tokenizers)
                block.add(own.column("text_").to_pylist(), own.column("row_"), whole)
                if block.full():
                    yield block.row(f"{TaskContext.get().partitionId()}-{made}")
                    made, block = made + 1, None
        if block:
            yield block.row(f"{TaskContext.get().partitionId()}-{made}")

    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row_"), F.col("text").alias("text_"))
    return common.staged(rows.mapInArrow(common.releasing(fill), schema), "alignment")


def pair_counts(made: DataFrame) -> DataFrame:
    """key, n: in how many documents of the corpus each pair of ids is linked."""
    return made.select(F.inline(F.arrays_zip("keys", "held"))).groupBy(F.col("keys").alias("key")).agg(F.sum("held").alias("n"))


def align(docs: DataFrame, keep: list[str] | None = None, paths: tuple[str, str] | None = None, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all but text, if not given) with the columns of RESULTS."""
    common.bounded_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*RESULTS, "text")]
    made = blocks(docs, keep, paths or tokenizer_paths())
    table = common.staged(pair_counts(made).filter("n > 1"), "pairs")
    most = table.groupBy(F.shiftright("key", 16).cast("int").alias("a")).agg(F.max("n").alias("most"))
    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return (count_sent if table.count() <= table_pairs else count_joined)(made, table, most, keep, kept)


def results(made: DataFrame, keep: list[str], kept: str, counts) -> DataFrame:
    """Rows of documents from blocks; ``counts`` gives each distinct pair's count and whether it is its A id's highest."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of = read_body(batch.column("body")[i].as_py())
                pairs, lengths, times = (of(c).to_numpy() for c in ("pairs", "lengths", "times"))
                n, best = counts(of("keys").to_numpy(), batch, i)
                place, numbers = of("places").to_numpy(), of("numbers").to_numpy()
                by_part = [differences(times * x[place], pairs)[numbers] for x in (best.astype(np.int64), n)]
                yield pa.RecordBatch.from_arrays(
                    [*of("rows").flatten(), *[of(c) for c in RESULTS[:4]], *[pa.array(differences(x, lengths)) for x in by_part],
                     of("digests")], [*keep, *RESULTS])

    return made.mapInArrow(common.releasing(total), f"{kept}" + ", ".join(f"{c} long" for c in RESULTS[:-1]) + f", {RESULTS[-1]} string")


def count_sent(made: DataFrame, table: DataFrame, most: DataFrame, keep: list[str], kept: str) -> DataFrame:
    """Counts from a table that every task gets."""
    found = table.orderBy("key").toArrow().combine_chunks()
    keys, n = (found.column(c).to_numpy() for c in ("key", "n"))
    tops = most.toArrow()
    top = np.ones(1 << 16, np.int64)
    top[tops.column("a").to_numpy()] = tops.column("most").to_numpy()
    small = n.astype(np.int32) if not len(n) or n.max() < 1 << 31 else n
    sent = made.sparkSession.sparkContext.broadcast((keys.astype(np.uint32), small, top))

    def counts(own: np.ndarray, batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        keys, n, top = sent.value
        out = np.ones(len(own), np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, own.astype(np.uint32)), len(keys) - 1)
            out = np.where(keys[at] == own, n[at], out).astype(np.int64)
        return out, out == top[own >> 16]

    return results(made.select("body"), keep, kept, counts)


def count_joined(made: DataFrame, table: DataFrame, most: DataFrame, keep: list[str], kept: str) -> DataFrame:
    """Counts joined to the distinct pairs of every block by a shuffle, back in their places."""
    tops = F.broadcast(most)                       # at most one row for each id of A's vocabulary
    own = made.select("block", F.posexplode("keys").alias("place", "key")).join(table, "key", "left").fillna(1, ["n"])
    own = own.withColumn("a", F.shiftright("key", 16).cast("int")).join(tops, "a", "left").fillna(1, ["most"])
    own = own.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "n", (F.col("n") == F.col("most")).alias("best")))).alias("of_"))
    both = made.select("block", "body").join(own, "block", "left").withColumns(
        {"n_": F.coalesce("of_.n", F.array().cast("array<bigint>")), "best_": F.coalesce("of_.best", F.array().cast("array<boolean>"))}).drop("of_")
    of = lambda batch, i, c: batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False)
    return results(both, keep, kept, lambda own, batch, i: (of(batch, i, "n_"), of(batch, i, "best_")))


def aligned_groups(docs: DataFrame, keep: list[str] | None = None, paths: tuple[str, str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``groups``: the ids of both tokenizers and the byte at which each group ends."""
    common.bounded_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("text", "groups")]
    files = paths or tokenizer_paths()
    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    kind = pa.list_(pa.struct([("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def align_texts(tokenizers: Tokenizers, texts: list[str | None]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        at = [i for i, t in enumerate(texts) if t]
        if not at:
            return out
        found = tokenizers.encode([texts[i] for i in at])
        begin = np.cumsum(differences(tokenizers.pieces_a.length[found.a], found.n_a))
        begin = np.concatenate(([0], begin)).tolist()
        for g, part in enumerate(found.part.tolist()):
            i, j = found.first_a[g], found.first_b[g]
            out[at[part]].append({"end": int(found.ends[g]) - begin[part], "a": found.a[i:i + found.size_a[g]].tolist(),
                                  "b": found.b[j:j + found.size_b[g]].tolist()})
        return out

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(*files)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                own = batch.slice(low, ROWS)
                found = pa.array(align_texts(tokenizers, own.column("text_").to_pylist()), kind)
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in keep], found], [*keep, "groups"])

    rows = docs.select(*keep, F.col("text").alias("text_"))
    return rows.mapInArrow(common.releasing(find), f"{kept}groups array<struct<end: bigint, a: array<int>, b: array<int>>>")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment of both tokenizers over all documents."""
    return align(common.documents(spark, sf_dir).select("doc_id", "text"))

"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. Every window of a text (a run of whole
words of at least ``WINDOW`` bytes of the lower-cased text, white space as one blank) is compressed with both; its gain is
how many bytes less it takes with the toxic dictionary. A text's windows add up to a log likelihood ratio of their
gains, which a calibrated logistic curve turns into the score.

Both dictionaries have the same layout: entropy tables and a body trained on ordinary windows, and behind it a tail of
``TAIL`` bytes, neutral in the ordinary one and trained on toxic text in the other. Ordinary wording therefore costs the same
with both, and only the tail makes a difference. The tail is trained on those parts of toxic windows whose
runs of ``GRAM`` bytes are at least ``RARER`` times as frequent in toxic as in ordinary text.

Fitting takes a bounded sample of labelled documents: at most ``TOXIC`` and ``ORDINARY`` documents, in order of a hash of doc_id,
and at most ``SAMPLE_BYTES`` of text of either kind, whole documents only. Gains for the calibration are those of dictionaries
that were trained on the other half of the sample; near copies fall into the same half. The curve is weighted to the
share of toxic labels in all of them, then moved towards even odds as far as at most ``FALSE_SHARE`` of the sample's ordinary
texts reach ``CUT``. Every text is scored whole, in tasks that hold the two
dictionaries only.

A null text is empty; an empty text has no window and gets the score of a text of which nothing is known. Labels that are
null or whose document is absent are not learned; of several labels of a document the highest counts. Without
documents of both kinds every score is 0. Repeated rows get equal scores; a very long text is cut into windows like
any other, a run without blanks is one window. Columns ``score`` and ``predicted`` of the input give way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 40
BODY, TAIL = 256 << 10, 2048
GRAM, RARER, LEAST = 6, 10, 3
TOXIC, ORDINARY, SAMPLE_BYTES = 1500, 3000, 6 << 20
CUT = 0.7
#: Share of ordinary texts of the sample that may reach the cut.
FALSE_SHARE = 0.015
GAINS = (-2, 9)
BUCKETS = 22
#: A byte that no UTF-8 text holds.
NEUTRAL = b"\xff"


class Windows:
    """Windows of several texts: where each begins, how long it is and whose it is."""

    def __init__(self, texts: list[str | None]):
        parts, begin, self.texts, base = [], [], len(texts), 0
        for text in texts:
            words = (text or "").lower().encode("utf-8", "replace").split()
            data = b" " + b" ".join(words) if words else b""
            blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
            at = np.searchsorted(blanks, np.arange(0, len(data), WINDOW))
            parts.append(data)
            begin.append(base + np.unique(blanks[at[at < len(blanks)]]))
            base += len(data)
        self.data, self.begin = b"".join(parts), np.concatenate(begin) if begin else np.empty(0, np.int64)
        ends = np.cumsum([len(p) for p in parts])
        self.text = np.searchsorted(ends, self.begin, side="right")
        self.length = np.diff(np.append(self.begin, base))

    def sizes(self, dictionary: bytes, of: np.ndarray | None = None) -> np.ndarray:
        """Compressed bytes of all windows, or of some."""
        import zstandard
        begin, length = (self.begin, self.length) if of is None else (self.begin[of], self.length[of])
        if not len(begin):
            return np.empty(0, np.int64)
        settings = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, compression_level=3, strategy=zstandard.STRATEGY_BTLAZY2, min_match=4,
            window_log=19, hash_log=17, chain_log=17, search_log=5, target_length=24,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=settings)
        cuts = np.stack((begin, length), axis=1).astype(np.uint64).tobytes()
        out = coder.multi_compress_to_buffer(zstandard.BufferWithSegments(self.data, cuts), threads=1)
        return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))

    def pieces(self, of: np.ndarray) -> list[bytes]:
        return [self.data[a:a + n] for a, n in zip(self.begin[of].tolist(), self.length[of].tolist())]


def trained(samples: list[bytes], size: int, k: int) -> bytes:
    """A dictionary of at most ``size`` bytes; too few samples are a plain one themselves."""
    import zstandard
    whole = b"".join(samples)
    size = min(size, max(256, len(whole) // 4))
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=GRAM).as_bytes()
    except zstandard.ZstdError:
        return whole[-size:]


def first_ones(pieces: list[bytes]) -> np.ndarray:
    """Which windows are the first with their bytes: copies teach nothing."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(p, i) == i for i, p in enumerate(pieces)), bool, len(pieces))


class Runs:
    """Buckets of the runs of GRAM bytes inside the windows."""

    def __init__(self, windows: Windows):
        x = np.frombuffer(windows.data, np.uint8)
        self.windows, room = windows, max(0, len(x) - GRAM + 1)
        self.window = np.repeat(np.arange(len(windows.length), dtype=np.int32), windows.length)[:room]
        inside = np.arange(room) + GRAM <= (windows.begin + windows.length)[self.window]
        self.at = np.flatnonzero(inside).astype(np.int32)
        self.window = self.window[self.at]
        out = np.zeros(len(self.at), np.uint64)
        for j in range(GRAM):
            out = (out << np.uint64(8)) | x[self.at + j]
        self.bucket = ((out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS)).astype(np.int32)

    def counted(self, of: np.ndarray) -> np.ndarray:
        """How often each bucket is in the windows marked in ``of``."""
        return np.bincount(self.bucket[of[self.window]], minlength=1 << BUCKETS)

    def tail(self, toxic: np.ndarray, ordinary: np.ndarray) -> bytes:
        """The tail trained on the parts of toxic windows that ordinary ones seldom hold; b'' if there are none."""
        own, ratio = self.counted(toxic), toxic.sum() / max(1, ordinary.sum())
        marked = (own >= LEAST) & (own > RARER * ratio * self.counted(ordinary))
        here = marked[self.bucket] & toxic[self.window]
        at, window = self.at[here], self.window[here]
        if not len(at):
            return b""
        cut = np.flatnonzero((np.diff(at) > GRAM) | (np.diff(window) > 0)) + 1
        first, last = at[np.insert(cut, 0, 0)], at[np.append(cut - 1, len(at) - 1)]
        samples = [self.windows.data[a:b + GRAM] for a, b in zip(first.tolist(), last.tolist())]
        return trained(samples, 8 * TAIL, 12)[-TAIL:]


def half_of(text: str | None) -> int:
    """A half that near copies share, as a rule: by the least hash of the text's longer words."""
    return min((zlib.crc32(w) for w in (text or "").lower().encode("utf-8", "replace").split() if len(w) > 6), default=0) // 7 % 2


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the constant."""
    x, beta = np.column_stack((x, np.ones(len(x)))), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(slope, x.T @ (weight * (y - p)) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Model:
    """Two dictionaries, the log likelihood ratio of each gain, and the curve of the score."""

    def __init__(self, body: bytes, tail: bytes, ratio: np.ndarray, beta: np.ndarray):
        self.body, self.tail, self.ratio, self.beta = body, tail, ratio, beta

    def gains(self, windows: Windows, of: np.ndarray | None = None) -> np.ndarray:
        if not self.tail:
            return np.zeros(len(windows.begin if of is None else of), np.int64)
        return windows.sizes(self.body + NEUTRAL * len(self.tail), of) - windows.sizes(self.body + self.tail, of)

    def evidence(self, gains: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """Per text: the sum of its windows' log ratios, that sum over the root of their number, and the largest gains."""
        clipped = np.clip(gains, GAINS[0], GAINS[1] - 1)
        total = np.bincount(text, self.ratio[clipped - GAINS[0]], minlength=texts)
        number = np.maximum(1, np.bincount(text, minlength=texts))
        most = np.zeros(texts)
        np.maximum.at(most, text, clipped)
        return np.column_stack((np.clip(total, -20, 20), total / np.sqrt(number), most, np.log(number)))

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.beta[:-1] + self.beta[-1], -30, 30)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        windows = Windows(texts)
        return self.scores(self.evidence(self.gains(windows), windows.text, len(texts)))


def fit(texts: list[str | None], labels: np.ndarray, share: float) -> Model | None:
    """Model of a sample; ``share`` is the share of toxic ones among all labels. None without texts of both kinds."""
    if not len(labels) or labels.min() == labels.max():
        return None
    windows = Windows(texts)
    runs, toxic = Runs(windows), labels[windows.text] == 1
    halves = np.array([half_of(t) for t in texts])[windows.text]
    plain = np.flatnonzero(~toxic)
    body_of = plain[np.argsort((plain * 0x9E3779B1) % (1 << 32))][:12 * BODY // WINDOW]
    body = trained(windows.pieces(body_of), BODY, 12) if len(body_of) else b""
    sick = np.zeros(len(toxic), bool)
    own = np.flatnonzero(toxic)
    sick[own[first_ones(windows.pieces(own))]] = True
    gains = np.zeros(len(toxic), np.int64)
    for h in (0, 1):
        held = Model(body, runs.tail(sick & (halves != h), ~toxic & (halves != h)), np.zeros(0), np.zeros(0))
        own = np.flatnonzero(halves == h)
        gains[own] = held.gains(windows, own)
    fresh = ~toxic
    fresh[body_of] = False                     # the body was trained on these
    bins = GAINS[1] - GAINS[0]
    seen = lambda which: np.bincount(np.clip(gains[which], GAINS[0], GAINS[1] - 1) - GAINS[0], minlength=bins) + 1.0
    bad, good = seen(toxic), seen(fresh if fresh.sum() > 1000 else ~toxic)
    model = Model(body, runs.tail(sick, ~toxic), np.log(bad / bad.sum() * good.sum() / good), np.zeros(0))
    evidence = model.evidence(gains, windows.text, len(texts))
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    model.beta = logistic(evidence, labels.astype(float), weight)
    # towards even odds, as far as ordinary texts of the sample stay below the cut
    line = np.quantile((evidence @ model.beta[:-1] + model.beta[-1])[labels == 0], 1 - FALSE_SHARE, method="higher")
    model.beta[-1] += np.clip(np.log(CUT / (1 - CUT)) - line - 1e-6, 0, max(0.0, np.log((1 - share) / share)))
    return model


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str | None], np.ndarray, float]:
    """Texts and labels of the bounded sample, and the share of toxic ones among all labels that may be learned."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = common.staged(known.withColumn("order_", F.xxhash64("doc_id")), "toxic-labels")
    whole, bad = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    wanted = known.filter("toxic = 1").orderBy("order_", "doc_id").limit(TOXIC).unionByName(
        known.filter("toxic = 0").orderBy("order_", "doc_id").limit(ORDINARY))
    wanted = common.staged(wanted, "toxic-wanted")
    found = docs.select("doc_id", common.text_of().alias("text")).join(F.broadcast(wanted), "doc_id")
    found = common.staged(found, "toxic-sample").withColumn("size", F.octet_length("text"))
    texts: list[str | None] = []
    of: list[int] = []
    for kind, most in ((1, TOXIC), (0, ORDINARY)):
        own = found.filter(F.col("toxic") == kind)
        sizes = own.select("order_", "doc_id", "size").orderBy("order_", "doc_id", "size").limit(most).toArrow()
        fits = np.cumsum(sizes.column("size").to_numpy().astype(np.int64)) <= SAMPLE_BYTES
        room = int(fits.sum())
        got = own.orderBy("order_", "doc_id", "size").limit(room).select("text").toArrow().column("text").to_pylist() if room else []
        texts.extend(got)
        of.extend([kind] * len(got))
    return texts, np.array(of, np.int64), (bad or 0) / max(1, whole)


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the labelled ones of ``docs`` (doc_id, text); ``labels`` has doc_id and toxic."""
    common.bounded_batches(docs.sparkSession)
    return fit(*sample(docs, labels))


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None, cut: float = CUT) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all, if not given) with score and predicted; nothing but the text is looked at."""
    common.bounded_batches(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                own = batch.slice(low, 256)
                found = model.score(own.column("text").to_pylist()) if model else np.zeros(own.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(c) for c in names], pa.array(found, pa.float64()),
                     pa.array((found >= cut).astype(np.int32), pa.int32())], [*names, "score", "predicted"])

    return docs.select(*names, *(["text"] if "text" not in names else [])).mapInArrow(common.releasing(rate), f"{fields}score double, predicted int")


def in_fold(mod: int, rest: int):
    """crc32 of doc_id as text, by its remainder."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % mod == rest


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of two of three folds."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~in_fold(3, 1))
    return predict(docs.select("doc_id", in_fold(3, 1).alias("held_out"), "text"), learn(docs, labels), keep=["doc_id", "held_out"])

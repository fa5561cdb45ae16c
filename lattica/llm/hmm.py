"""Language-model scoring by a hidden Markov model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import fold_of, materialize, table, text_batches

#: Latent states; most tokens with an emission of their own; most tokens whose counts are sent to every task.
STATES, OWN, COMMON = 8, 16_000, 200_000
#: Classes of the other tokens, by their last bytes. A state emits the class, the class emits the token.
CLASSES, SUFFIX = 251, 3
#: Weight of the overall shares in a state's emissions, and of even shares in its transitions.
PRIOR, EVEN = 200.0, 1.0
#: Parts of the training documents, of SLICES, and rounds over each, before the rounds over all of them.
SLICES, WARM = 32, ((1, 10), (4, 4))
#: Rounds over all training documents end when one gains less log10 probability a token than GAIN, or after MOST.
GAIN, MOST = 0.004, 6
#: Tokens that are worked on at a time, in training and in scoring; a longer document is a group of its own.
TRAIN_TOKENS, SCORE_TOKENS = 1_000_000, 1_500_000
#: Tokens whose forward messages are held at a time; those of longer documents are made again on the way back.
BLOCK = 2_000_000
CACHE = 300_000


def class_of(token: bytes) -> int:
    return crc32(token[-SUFFIX:]) % CLASSES


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; bytes.lower and bytes.split do exactly that."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a partition's tokens, passed on whenever CACHE different ones are held."""

    def rows(found: Counter) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "token": np.fromiter((xxhash.xxh3_64_intdigest(t) for t in found), np.uint64, len(found)).view(np.int64),
                "class": np.fromiter((class_of(t) for t in found), np.int32, len(found)),
                "c": np.fromiter(found.values(), np.int64, len(found)),
            }
        )

    found: Counter[bytes] = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            found.update(tokens(text))
        if len(found) > CACHE:
            yield rows(found)
            found = Counter()
    yield rows(found)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(token, class, c): how often each token, by its 64-bit hash, occurs in all texts of docs."""
    text_batches(docs.sparkSession)
    return docs.select("text").mapInPandas(_counts, "token bigint, class int, c bigint").groupBy("token", "class").agg(F.sum("c").alias("c"))


def frequent(vocab: DataFrame, most: int) -> int:
    """The least count such that at most `most` tokens have it or more."""
    by_count = vocab.groupBy("c").agg(F.count("*").alias("n"))
    ranked = [tuple(r) for r in by_count.orderBy(F.col("c").desc()).limit(most + 1).collect()]
    total, least = 0, None
    for c, n in ranked:
        total += n
        if total > most:
            break
        least = c
    return least if least is not None else 2**62


# --- sequences of symbols, many at a time -------------------------------------------------------------------------


def _by_position(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes by falling length, all symbols by position and then in that order, and where each position starts."""
    size = np.array([len(s) for s in seqs], np.int64)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    off = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(off[-1], np.int64)
    for k, i in enumerate(order):
        flat[off[: size[k]] + k] = seqs[i]
    return order, flat, off


def log10_likelihood(seqs: list[np.ndarray], model: dict) -> np.ndarray:
    """Exact log10 probability of each symbol sequence by the scaled forward recursion."""
    start, move, emit = model["start"], model["move"], model["emit"]
    order, flat, off = _by_position(seqs)
    out = np.zeros(len(seqs))
    alpha = np.zeros((len(seqs), len(start)))
    for t in range(len(off) - 1):
        n = off[t + 1] - off[t]
        alpha = (alpha[:n] @ move if t else start) * emit[flat[off[t] : off[t + 1]]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        out[:n] += np.log10(scale)
    back = np.zeros(len(seqs))
    back[order] = out
    return back


def expected_counts(seqs: list[np.ndarray], model: dict) -> dict:
    """Baum-Welch over whole sequences: expected starts, transitions and emissions, and the log10 probability.

    Forward messages are kept for BLOCK tokens at a time. Before that, only the message that enters each block is, and
    the way back makes the others again.
    """
    start, move, emit = (model[k].astype(np.float32) for k in ("start", "move", "emit"))
    _, flat, off = _by_position(seqs)
    s, last = len(start), len(off) - 1
    out = {"start": np.zeros(s), "move": np.zeros((s, s)), "emit": np.zeros((len(emit), s)), "log": 0.0}
    if not last:
        return out

    def ahead(t0: int, t1: int, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, forward messages and their scales at positions t0 to t1, after the message a."""
        lo, e = off[t0], emit[flat[off[t0] : off[t1]]]
        alpha, scale = np.empty_like(e), np.empty(len(e), np.float32)
        for t in range(t0, t1):
            x, y = off[t] - lo, off[t + 1] - lo
            a = (a[: y - x] @ move if t else start) * e[x:y]
            scale[x:y] = a.sum(1)
            a /= scale[x:y, None]
            alpha[x:y] = a
        return e, alpha, scale

    cuts = [0]
    while cuts[-1] < last:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(off, off[cuts[-1]] + BLOCK, side="right")) - 1))
    entering, held = [np.zeros((0, s), np.float32)], None
    for t0, t1 in zip(cuts, cuts[1:], strict=False):
        held = ahead(t0, t1, entering[-1])
        out["log"] += float(np.log10(held[2].astype(float)).sum())
        entering.append(held[1][off[t1 - 1] - off[t0] :].copy())
    beta = np.ones((off[1], s), np.float32)
    for k in range(len(cuts) - 2, -1, -1):
        t0, t1, lo = cuts[k], cuts[k + 1], off[cuts[k]]
        e, alpha, scale = held if held is not None else ahead(t0, t1, entering[k])
        held = None
        gamma = np.empty_like(alpha)
        for t in range(t1 - 1, t0 - 1, -1):
            x, y = off[t] - lo, off[t + 1] - lo
            b = beta[: y - x]
            gamma[x:y] = alpha[x:y] * b
            if t:
                # The message into the position before, and the transitions from there.
                b = e[x:y] * b / scale[x:y, None]
                before = alpha[off[t - 1] - lo :][: y - x] if t > t0 else entering[k][: y - x]
                out["move"] += before.T @ b
                beta[: y - x] = b @ move.T
        if not t0:
            out["start"] += gamma[: off[1]].sum(0)
        for j in range(s):
            out["emit"][:, j] += np.bincount(flat[lo : off[t1]], gamma[:, j], len(emit))
    out["move"] *= move
    return out


class _Codes(dict):
    """Codes of tokens: the place in the head, or after it the place among the rare tokens met."""

    def __init__(self, head: np.ndarray):
        self.place = {int(h): i for i, h in enumerate(head)}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.hashes: list[int] = []
        self.classes: list[int] = []

    def __missing__(self, token: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(token)
        h = h - (1 << 64) if h >> 63 else h
        code = self.place.get(h)
        if code is None:
            code = len(self.place) + len(self.hashes)
            self.hashes.append(h)
            self.classes.append(class_of(token))
        self[token] = code
        return code


def reestimate(counts: dict, shares: np.ndarray) -> dict:
    """Model of expected counts, smoothed by the overall shares of symbols, so that nothing has probability zero."""
    start = counts["start"] + EVEN
    move = counts["move"] + EVEN
    emit = counts["emit"] + PRIOR * shares[:, None]
    return {"start": start / start.sum(), "move": move / move.sum(1, keepdims=True), "emit": emit / emit.sum(0)}


def first_model(shares: np.ndarray) -> dict:
    """Overall shares, disturbed by a fixed seed; states tend to stay."""
    rng = np.random.default_rng(11)
    emit = shares[:, None] * rng.uniform(0.5, 1.5, (len(shares), STATES))
    return {"start": np.full(STATES, 1 / STATES), "move": np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES), "emit": emit / emit.sum(0)}


def in_groups(seqs: Iterator[np.ndarray], most: int) -> Iterator[list[np.ndarray]]:
    group, size = [], 0
    for seq in seqs:
        group.append(seq)
        size += len(seq)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


# --- the operator -------------------------------------------------------------------------------------------------


def score(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs has doc_id, text and held_out; rows that are not held out train the model. Symbols are the most frequent
    tokens, the end, and classes of other tokens; a class emits its tokens by add-one shares with one share for all
    unknown ones, so score is the log10 of a proper probability: forward recursion over the symbols, plus the shares of
    the classes' tokens. Counts of rare tokens come from a join with the vocabulary, by hashes of 64 bits.
    Null texts are empty: their one token is the end. Rows are told apart by id and text; repeated rows score alike.
    Without training rows all tokens are unknown. Empty tables give no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held_out").withColumn("row", F.xxhash64("doc_id", "text"))
    training = docs.filter(~F.col("held_out"))
    vocab = materialize(vocabulary(training), "lm-vocabulary")
    n_docs = training.count()
    n_words, n_types = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, types = n_words + n_docs, n_types + (1 if n_docs else 0)
    common_from, own_from = frequent(vocab, COMMON), frequent(vocab, OWN)
    head = vocab.filter(F.col("c") >= common_from).orderBy(F.col("c").desc(), "token").toPandas()
    own = int((head["c"] >= own_from).sum())
    by_class = np.zeros((CLASSES, 2))
    for r in vocab.filter(F.col("c") < own_from).groupBy("class").agg(F.sum("c"), F.count("*")).collect():
        by_class[r[0]] = r[1], r[2]
    end = own
    counts = np.concatenate([head["c"].to_numpy(float)[:own], [n_docs], by_class[:, 0]])
    shares = (counts + 1) / (counts + 1).sum()
    known = {"token": head["token"].to_numpy(np.int64), "class": head["class"].to_numpy(np.int64), "c": head["c"].to_numpy(np.int64), "own": own, "class_total": by_class.sum(1) + 1, "n_docs": n_docs}
    sent = spark.sparkContext.broadcast(known)

    @F.pandas_udf("symbols array<int>, n_tokens bigint, n_known bigint, base double, inner double, rare array<bigint>, times array<bigint>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        """Symbols, sums over common tokens, and the rare tokens of each row."""
        k = sent.value
        own, n_head = k["own"], len(k["token"])
        code_of = _Codes(k["token"])
        for texts in batches:
            if len(code_of) > CACHE:
                code_of.forget()
            found = [tokens(t) for t in texts]
            sizes = np.array([len(f) for f in found], np.int64)
            flat = np.fromiter((code_of[t] for f in found for t in f), np.int64, sizes.sum())
            of = np.repeat(np.arange(len(found)), sizes)
            hashes = np.array(code_of.hashes, np.int64)
            classes = np.concatenate([k["class"], np.array(code_of.classes, np.int64)])
            # Rare tokens count as 1 here; the join adds what training has of them.
            log_c = np.concatenate([np.log10(k["c"] + 1.0), np.zeros(len(hashes))])
            classed = np.arange(len(classes)) >= own
            symbol = np.where(classed, own + 1 + classes, np.arange(len(classes))).astype(np.int32)
            inner = np.where(classed, log_c - np.log10(k["class_total"])[classes], 0.0)
            rare = flat >= n_head
            met, times = np.unique(of[rare] * max(1, len(hashes)) + flat[rare] - n_head, return_counts=True)
            cut = np.searchsorted(met, np.arange(1, len(found)) * max(1, len(hashes)))
            ends = np.cumsum(sizes)
            yield pd.DataFrame(
                {
                    "symbols": [np.append(symbol[flat[e - n : e]], np.int32(own)) for e, n in zip(ends, sizes, strict=True)],
                    "n_tokens": sizes + 1,
                    "n_known": sizes - np.bincount(of[rare], minlength=len(found)) + (k["n_docs"] > 0),
                    "base": np.bincount(of, log_c[flat], len(found)) + np.log10(k["n_docs"] + 1.0),
                    "inner": np.bincount(of, inner[flat], len(found)),
                    "rare": np.split(hashes[met % max(1, len(hashes))] if len(hashes) else hashes, cut),
                    "times": np.split(times, cut),
                }
            )

    # Held-out rows, and training rows by the part that the first rounds read, in folders of their own.
    slice_ = F.pmod(F.xxhash64("row", F.lit("slice")), F.lit(SLICES))
    part = F.when(F.col("held_out"), F.lit(-1))
    for k, (most, _) in enumerate(WARM):
        part = part.when(slice_ < most, k)
    coded = docs.select("doc_id", "held_out", "row", part.otherwise(len(WARM)).alias("part"), encode("text").alias("e")).select("doc_id", "held_out", "row", "part", "e.*")
    rows = materialize(coded, "lm-symbols", "part")
    model = train(rows, shares)
    told = spark.sparkContext.broadcast(model)

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += int(pdf["n_tokens"].sum())
            if size >= SCORE_TOKENS:
                yield scored(pd.concat(held))
                held, size = [], 0
        if held:
            yield scored(pd.concat(held))

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        likelihood = log10_likelihood([np.asarray(s) for s in pdf["symbols"]], told.value)
        return pdf.drop(columns=["symbols"]).assign(sequence=likelihood)

    # Rare tokens that training has: log10(c + 1) by a join on the hash; those it lacks add nothing.
    tail = vocab.filter(F.col("c") < common_from).select(F.col("token").alias("rare"), F.log10(F.col("c") + 1).alias("log_c"))
    pairs = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", "r.rare", "r.times")
    met = pairs.join(tail, "rare").groupBy("row").agg(F.sum(F.col("times") * F.col("log_c")).alias("rare_log"), F.sum("times").alias("rare_known"))
    # Repeated rows are summed together above; each takes its share.
    copies = rows.groupBy("row").agg(F.count("*").alias("copies")).filter("copies > 1")
    met = met.join(copies, "row", "left").select("row", *[(F.col(x) / F.coalesce("copies", F.lit(1))).alias(x) for x in ("rare_log", "rare_known")])
    # The id passes through Python as text: a null would make numbers of it that can't hold all ids.
    texts = rows.select(F.col("doc_id").cast("string"), "held_out", "row", "n_tokens", "n_known", "base", "inner", "symbols")
    kept = texts.mapInPandas(forward, "doc_id string, held_out boolean, row bigint, n_tokens bigint, n_known bigint, base double, inner double, sequence double")
    kept = kept.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    both = kept.join(met, "row", "left").withColumn("rare_log", F.coalesce("rare_log", F.lit(0.0)))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_log") - F.col("n_tokens") * float(np.log10(total + types + 1))).alias("base_score"),
        (F.col("sequence") + F.col("inner") + F.col("rare_log")).alias("score"),
    )


def train(rows: DataFrame, shares: np.ndarray) -> dict:
    """Baum-Welch over whole training documents: each round sums expected counts of every partition by symbol.

    The first rounds read growing parts of the documents, which grow with the input; each round replaces all counts of
    the one before. Rounds over all documents follow until the gain is below GAIN. Only sums by symbol reach the driver,
    whose number is bounded.
    """
    model, gains = first_model(shares), []
    for k, (_, rounds) in enumerate(WARM):
        for _ in range(rounds):
            model = _round(rows.filter(F.col("part").between(0, k)), model, shares)[0]
    before = None
    for _ in range(MOST):
        new, log, n = _round(rows.filter("part >= 0"), model, shares)
        gains.append(log / n if n else 0.0)
        model = new
        if not n or (before is not None and gains[-1] - before < GAIN):
            break
        before = gains[-1]
    return model | {"log10_per_token": gains}


def _round(training: DataFrame, model: dict, shares: np.ndarray) -> tuple[dict, float, int]:
    """The model after a round, and the log10 probability and number of the symbols under the one before."""
    states, symbols = STATES, len(shares)
    told = training.sparkSession.sparkContext.broadcast({k: model[k] for k in ("start", "move", "emit")})
    names = [f"s{k}" for k in range(states)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = None, 0
        for group in in_groups((np.asarray(s) for pdf in batches for s in pdf["symbols"]), TRAIN_TOKENS):
            got = expected_counts(group, told.value)
            n += sum(map(len, group))
            sums = got if sums is None else {k: sums[k] + got[k] for k in got}
        if sums is not None:
            # Rows: symbols first, then the transitions of each state, the starts, and what the round tells of itself.
            told_of = np.zeros((1, states))
            told_of[0, :2] = sums["log"], n
            values = np.concatenate([sums["emit"], sums["move"], sums["start"][None], told_of])
            yield pd.DataFrame({"at": np.arange(len(values), dtype=np.int32)} | {c: values[:, k] for k, c in enumerate(names)})

    sums = training.select("symbols").mapInPandas(count, "at int, " + ", ".join(f"{c} double" for c in names)).groupBy("at").agg(*[F.sum(c).alias(c) for c in names])
    got = sums.toPandas()
    told.destroy()
    if not len(got):
        return model, 0.0, 0
    values = np.zeros((symbols + states + 2, states))
    values[got["at"].to_numpy()] = got[names].to_numpy()
    return reestimate({"emit": values[:symbols], "move": values[symbols : symbols + states], "start": values[-2]}, shares), float(values[-1, 0]), int(values[-1, 1])


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs.withColumn("held_out", fold_of(F.col("doc_id"), 7) == 2))


QUERIES = {"op6_language_model": op6_language_model}
ORACLES: dict[str, str] = {}

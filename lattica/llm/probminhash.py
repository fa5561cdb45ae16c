"""Near-duplicate detection by ProbMinHash, banding and exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import materialize, sized, table, text_batches

#: Words of a shingle and the least probability Jaccard of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Signature components, bands and their rows: of pairs at the threshold, (1 - 0.8^4)^24 = 3e-6 share no band.
COMPONENTS, BANDS, ROWS = 128, 24, 4
#: Pairs whose signatures agree less are no candidates; the threshold is four standard errors above.
MAYBE = 0.66
#: Bands of the first round, which joins most copies; all further rounds take all bands.
FIRST_BANDS = 8
#: Members of a bucket that one task compares at a time; larger buckets are dealt over several tasks. In the last round
#: every block of them meets every other one.
CHUNK, BLOCK = 512, 1024
#: Rounds in which each member of a bucket proposes its best partner; then all pairs left are verified where they meet.
BEST_ROUNDS = 2
CACHE = 400_000


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: dict) -> tuple[np.ndarray, np.ndarray, str]:
    """Distinct shingle hashes, how often each occurs, and a digest of the words; shorter texts are one shingle."""
    found = re.findall(r"\w+", (text or "").lower())
    digest = xxhash.xxh3_128_hexdigest(" ".join(found).encode("utf-8", "surrogatepass"))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0), digest
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = _mix(out + h[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    values, counts = np.unique(out, return_counts=True)
    return values, counts.astype(float), digest


def signatures(elements: list[tuple[np.ndarray, np.ndarray]], m: int = COMPONENTS) -> np.ndarray:
    """ProbMinHash of each weighted set: the element of the earliest arrival at each of m components (0 for empty sets).

    Every element is a Poisson process whose rate is its weight; each arrival goes to a random component. All sets
    advance arrival by arrival together, and an element ends as soon as its time exceeds the latest of the times that
    its set's components have so far, since later arrivals change nothing.
    """
    sets = len(elements)
    x = np.concatenate([e for e, _ in elements]) if sets else np.zeros(0, np.uint64)
    w = np.concatenate([c for _, c in elements]) if sets else np.zeros(0)
    of = np.repeat(np.arange(sets), [len(e) for e, _ in elements])
    first, sig = np.full(sets * m, np.inf), np.zeros(sets * m, np.uint64)
    t, turn, state = np.zeros(len(x)), 0, x.copy()
    while len(x):
        turn += 1
        state = _mix(state + np.uint64(0x9E3779B97F4A7C15))
        t = t - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        slot = of * m + (_mix(state ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, t)
        won = t == first[slot]
        sig[slot[won]] = x[won]
        go = t <= first.reshape(sets, m).max(1)[of]
        x, w, of, t, state = x[go], w[go], of[go], t[go], state[go]
    return sig.reshape(sets, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets, in the time of a sort; 0 if one is empty."""
    keys = np.union1d(a[0], b[0])
    if not len(a[0]) or not len(b[0]):
        return 0.0
    wa, wb = np.zeros(len(keys)), np.zeros(len(keys))
    wa[np.searchsorted(keys, a[0])] = a[1]
    wb[np.searchsorted(keys, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = np.where(wb > 0, wa / np.where(wb > 0, wb, 1), np.inf)
    order = np.argsort(-ratio, kind="stable")
    wa, wb = wa[order], wb[order]
    above, below = np.cumsum(wa), wb.sum() - np.cumsum(wb)
    both = (wa > 0) & (wb > 0)
    # For element i: sum of max(wa_j / wa_i, wb_j / wb_i); the first wins for ratios at least that of i.
    return float((1 / (above[both] / wa[both] + below[both] / wb[both])).sum())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the words, sig and bands (null for texts without words)."""

    @F.pandas_udf("digest string, sig binary, bands array<bigint>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for texts in batches:
            found = [shingles(t, words) for t in texts]
            sig = signatures([(e, c) for e, c, _ in found])
            full = [len(e) > 0 for e, _, _ in found]
            bytes_ = (_mix(sig) >> np.uint64(56)).astype(np.uint8)
            band = np.zeros((len(sig), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                band = _mix(band + sig[:, r : BANDS * ROWS : ROWS] * np.uint64(0x9E3779B97F4A7C15))
            yield pd.DataFrame(
                {
                    "digest": [d for _, _, d in found],
                    "sig": [s.tobytes() if f else None for s, f in zip(bytes_, full, strict=True)],
                    "bands": [b.view(np.int64) if f else None for b, f in zip(band, full, strict=True)],
                }
            )

    return docs.select("doc_id", sketch(F.coalesce("text", F.lit(""))).alias("s")).select("doc_id", "s.*")


def agreement(sigs: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of each with each from one-byte components, corrected for chance."""
    equal = np.count_nonzero(sigs[:, None, :] == others[None, :, :], axis=2) / sigs.shape[1]
    return (equal - 1 / 256) * 256 / 255


def _commonest(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which members are of the commonest class, and which are not: those of one class need no comparison."""
    values, counts = np.unique(classes, return_counts=True)
    common = classes == values[counts.argmax()]
    return np.flatnonzero(common), np.flatnonzero(~common)


def chunk_best(ids: np.ndarray, classes: np.ndarray, sigs: np.ndarray) -> pd.DataFrame:
    """Each member with the one of another class that it agrees with most, if they may be similar."""
    out: set[tuple[int, int]] = set()
    common, others = _commonest(classes)
    for rows, columns in ((others, np.arange(len(ids))), (common, others)):
        for k in range(0, len(rows), 64):
            i = rows[k : k + 64]
            near = agreement(sigs[i], sigs[columns])
            near[classes[i, None] == classes[None, columns]] = 0
            j = near.argmax(1)
            some = np.nonzero(near[np.arange(len(j)), j] >= MAYBE)[0]
            a, b = ids[i[some]], ids[columns[j[some]]]
            out.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
    return pd.DataFrame(sorted(out), columns=["a", "b"])


def _pairs(classes: np.ndarray, sides: np.ndarray, sigs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, agreement) of the pairs of different classes that may be similar, by parts; of two blocks only those across."""
    apart = len(np.unique(sides)) > 1
    common, others = _commonest(classes)
    is_common = np.zeros(len(classes), bool)
    is_common[common] = True
    for k in range(0, len(others), 64):
        rows = others[k : k + 64]
        near = agreement(sigs[rows], sigs)
        near[classes[rows, None] == classes[None, :]] = 0
        if apart:
            near[sides[rows, None] == sides[None, :]] = 0
        i, j = np.nonzero(near >= MAYBE)
        near, i = near[i, j], rows[i]
        keep = (i < j) | is_common[j]
        yield i[keep], j[keep], near[keep]


def chunk_members(bucket: int, chunk: int, ids: np.ndarray, classes: np.ndarray, sides: np.ndarray, sigs: np.ndarray) -> pd.DataFrame:
    """The members of a chunk that have a candidate in it: at most one row for each."""
    met = np.zeros(len(ids), bool)
    for i, j, _ in _pairs(classes, sides, sigs):
        met[i] = met[j] = True
    return pd.DataFrame({"bucket": bucket, "chunk": chunk, "rep": ids[met], "class": classes[met], "side": sides[met]})


def chunk_links(bucket: int, ids: np.ndarray, classes: np.ndarray, sides: np.ndarray, sigs: np.ndarray, bands: np.ndarray, sets: list) -> pd.DataFrame:
    """Exactly verified links that join the classes of a chunk: a forest, so at most one for each member.

    Every pair that may be similar is verified, unless its classes are joined already or an earlier band has the pair.
    """
    parent = {c: c for c in classes.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for i, j, near in _pairs(classes, sides, sigs):
        first = (bands[i] == bands[j]).argmax(1)
        mine = np.nonzero(bands[i, first] == bucket)[0]
        for at in mine[np.argsort(-near[mine], kind="stable")].tolist():
            x, y = int(i[at]), int(j[at])
            p, q = root(int(classes[x])), root(int(classes[y]))
            if p != q and (similar := probability_jaccard(sets[x], sets[y])) >= SIMILARITY:
                parent[max(p, q)] = min(p, q)
                out.append((min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y])), similar))
    return pd.DataFrame(out, columns=["a", "b", "similarity"])


#: What a round asks of its chunks, and the columns that a chunk's rows have for it.
BEST, MEMBERS, LINKS = "best", "members", "links"
NEEDS = {BEST: ["rep", "class", "sig"], MEMBERS: ["rep", "class", "sig", "side"], LINKS: ["rep", "class", "sig", "side", "bands", "elements", "weights"]}


def _in_chunks(what: str):
    """Rows sorted by (bucket, chunk), of which one chunk alone is held in memory."""

    def done(key: tuple, rows: list[tuple]) -> pd.DataFrame | None:
        if len(rows) < 2 or min(r[1] for r in rows) == max(r[1] for r in rows):
            return None
        ids, classes = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        sigs = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
        if what == BEST:
            return chunk_best(ids, classes, sigs)
        sides = np.array([r[3] for r in rows])
        if what == MEMBERS:
            return chunk_members(*key, ids, classes, sides, sigs)
        sets = []
        for r in rows:
            e = np.frombuffer(r[5], np.uint64)
            sets.append((e, np.frombuffer(r[6], np.float64) if r[6] else np.ones(len(e))))
        return chunk_links(key[0], ids, classes, sides, sigs, np.stack([r[4] for r in rows]), sets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []
        for pdf in batches:
            for bucket, chunk, *row in zip(pdf["bucket"], pdf["chunk"], *[pdf[n] for n in NEEDS[what]], strict=True):
                if (bucket, chunk) != key:
                    if (out := done(key, rows)) is not None and len(out):
                        yield out
                    key, rows = (bucket, chunk), []
                rows.append(tuple(row))
        if (out := done(key, rows)) is not None and len(out):
            yield out

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingles of each text; weights only where one isn't 1."""
    words = _Words()
    for pdf in batches:
        found = [shingles(t, words) for t in pdf["text"]]
        yield pd.DataFrame({"rep": pdf["doc_id"], "elements": [e.tobytes() for e, _, _ in found], "weights": [c.tobytes() if (c != 1).any() else None for _, c, _ in found]})


def buckets(reps: DataFrame) -> DataFrame:
    """(rep, bucket, band) of all bands that a text shares with another one."""
    rows = reps.select("rep", F.posexplode("bands").alias("band", "bucket")).repartition("bucket")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    return rows.join(shared, "bucket").select("rep", "bucket", "band")


def mixed_chunks(members: DataFrame, classes: DataFrame | None, turn: int, blocks: bool) -> DataFrame:
    """(bucket, chunk, rep, class, side) of the buckets that have members of several classes.

    Those of more than CHUNK members are dealt over tasks by a hash, another one each turn. With blocks, they are dealt
    into blocks, and each pair of blocks is a chunk, as is each block by itself; side is a member's block.
    """
    most = BLOCK if blocks else CHUNK
    rows = members.join(classes.withColumnRenamed("node", "rep"), "rep", "left") if classes is not None else members.withColumn("label", F.lit(None).cast("bigint"))
    rows = rows.select("rep", "bucket", F.coalesce("label", "rep").alias("class"))
    mixed = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("class").alias("low"), F.max("class").alias("high"))
    mixed = mixed.filter("low < high").select("bucket", F.ceil(F.col("members") / most).cast("int").alias("chunks"))
    dealt = rows.join(mixed, "bucket").withColumn("side", F.pmod(F.xxhash64("rep", F.lit(turn)), F.col("chunks")).cast("int"))
    if not blocks:
        return dealt.select("bucket", F.col("side").alias("chunk"), "rep", "class", "side")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.select("bucket", (F.least("side", "other") * F.col("chunks") + F.greatest("side", "other")).alias("chunk"), "rep", "class", "side")


def _by_chunk(df: DataFrame) -> DataFrame:
    return df.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk")


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words, held = _Words(), {}
    for pdf in batches:
        keep = []
        for a, ta, tb in zip(pdf["a"], pdf["text_a"], pdf["text_b"], strict=True):
            if a not in held:
                held = {a: shingles(ta, words)[:2]}
            keep.append(probability_jaccard(held[a], shingles(tb, words)[:2]))
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": keep})


def verify(links: DataFrame, docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) of the links whose exact probability Jaccard is at least `least`; only texts of links move."""
    ids = materialize(links.select(F.col("a").alias("doc_id")).union(links.select("b")).distinct(), "near-ids")
    texts = docs.select("doc_id", "text").join(sized(ids), "doc_id", "left_semi")
    pairs = links.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    pairs = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return pairs.select("a", "b", "text_a", "text_b").mapInPandas(_verified, "a bigint, b bigint, similarity double").filter(F.col("similarity") >= least)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, by alternating large and small stars.

    Every round is written to the shared folder; rounds end when the edges no longer change. Only two sums reach the
    driver.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = materialize(small.filter("u <> v").distinct(), "stars")
        after = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if after == state:
            break
        state = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))


def link(reps: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, similarity) that join the texts reps (rep, sig, bands) into classes, and (node, label).

    A link within a class that others have joined already is not looked for, so that groups of thousands of copies
    take a few links each; every candidate pair between different classes is verified.
    """
    members, sigs = materialize(buckets(reps), "near-buckets"), reps.select("rep", "sig")

    def joined(links: DataFrame, label: DataFrame | None) -> DataFrame:
        edges = links.select("a", "b")
        edges = edges if label is None else edges.unionByName(label.select(F.col("node").alias("a"), F.col("label").alias("b")))
        return materialize(components(edges), "near-labels")

    tried = links = label = None
    for turn in range(BEST_ROUNDS):
        some = members if turn else members.filter(F.col("band") < FIRST_BANDS)
        found = _by_chunk(mixed_chunks(some, label, turn, False).join(sigs, "rep").select("bucket", "chunk", "rep", "class", "sig"))
        found = found.mapInPandas(_in_chunks(BEST), "a bigint, b bigint").distinct()
        found = materialize(found.join(tried, ["a", "b"], "left_anti") if tried is not None else found, "near-candidates")
        tried = found if tried is None else tried.unionByName(found)
        new = materialize(verify(found, docs), "near-verified")
        links = new if links is None else links.unionByName(new)
        label = joined(new, label)
    # Candidates are sought by signatures alone; shingles come only for the members that have one.
    left = _by_chunk(mixed_chunks(members, label, BEST_ROUNDS, True).join(sigs, "rep").select("bucket", "chunk", "rep", "class", "sig", "side"))
    left = materialize(left.mapInPandas(_in_chunks(MEMBERS), "bucket bigint, chunk int, rep bigint, class bigint, side int"), "near-mixed")
    ids = sized(materialize(left.select(F.col("rep").alias("doc_id")).distinct(), "near-mixed-ids"))
    sets = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInPandas(_sets, "rep bigint, elements binary, weights binary")
    met = left.join(reps, "rep").join(sets, "rep").select("bucket", "chunk", "rep", "class", "sig", "side", "bands", "elements", "weights")
    new = materialize(_by_chunk(met).mapInPandas(_in_chunks(LINKS), "a bigint, b bigint, similarity double"), "near-verified")
    return links.unionByName(new).dropDuplicates(["a", "b"]), joined(new, label)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least doc_id of its class), n_links (verified links that joined its text).

    Words are runs of letters, digits and underscores, lower-cased. Documents with equal words are one text; texts are
    linked at SIMILARITY, and classes are connected components. Texts without words (null, empty) are classes of their
    own. Rows that share a doc_id count as one document. A null doc_id is never linked: its class is that of the rows
    with equal words, null if none has an id. Empty tables give no rows.
    """
    text_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = materialize(sketches(docs), "near-sketches")
    same = rows.filter("sig is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = materialize(same, "near-texts")
    links, label = link(reps.filter("rep is not null").select("rep", "sig", "bands"), docs)
    degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    classes = reps.select("digest", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    classes = materialize(classes.select("digest", F.coalesce("label", "rep").alias("class_id"), "n_links"), "near-classes")
    out = rows.select("doc_id", F.when(F.col("sig").isNotNull(), F.col("digest")).alias("digest")).join(classes, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id"))
    return out.select("doc_id", F.coalesce("class_id", own).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_near_duplicates": op9_near_duplicates}
ORACLES: dict[str, str] = {}

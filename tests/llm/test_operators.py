"""The training-data operators against SQL, brute force, round trips and held-out accuracy."""

import base64
import bz2
import gzip
import hashlib
import lzma
import math
import random
import re
import time
import zlib
from collections import Counter
from itertools import product
from urllib.parse import quote
from zlib import crc32

import numpy as np
import pytest

from lattica.llm import chat, hmm, mixing, probminhash, quality, queries, secrets, simhash, toxicity, warc, winnowing
from tests.compare import assert_same, duck

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, size string, key int, run int, digest string, score string, found int, words int"
EXTRA = ("en", "a", 1, "r", "s", 1, 1, "d", "s", 1, 1)
LONG = " ".join(f"word{k}" for k in range(70_000))


def docs(spark, rows):
    """Rows of (doc_id, text[, source]) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", (s[0] if s else "a"), *EXTRA[2:]) for i, t, *s in rows], DOC)


ODD = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, LONG), (6, "tie tie tie"), (6, "tie tie tie"), (None, "no id here"), (None, None), (2**60 + 1, "large id"), (7, "Ünïcode ß 日本語 🎈")]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_sql(spark, name, sf_dir):
    assert_same(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])


# --- mixing -------------------------------------------------------------------------------------------------------


def test_mix_odd_rows(spark):
    out = mixing.mix(docs(spark, [(*r, None if k % 3 == 0 else "b") for k, r in enumerate(ODD)])).collect()
    assert len(out) == len(ODD)
    total = sum(r["size"] for r in out)
    assert sum(r["taken"] for r in out) == pytest.approx(total, abs=2)
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    assert mixing.mix(docs(spark, [])).collect() == []


def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 0)], "source string, source_size bigint")
    out = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # Shares 1:2:3:1 of 1110 exceed 3 * 10 and 3 * 100, and c takes what is left of the total.
    assert out[None] == 0 and out["b"] == 30 and sum(out.values()) == pytest.approx(1110)
    assert out["a"] == pytest.approx(1080 / 4) and out["c"] == pytest.approx(1080 * 3 / 4)


def test_mix_reruns_agree(spark):
    rows = [(k, "w " * (k % 17 + 1), "hot" if k % 3 else f"s{k % 5}") for k in range(300)]
    a = sorted(map(tuple, mixing.mix(docs(spark, rows)).collect()))
    assert a == sorted(map(tuple, mixing.mix(docs(spark, rows[::-1]).repartition(7)).collect()))
    taken, target = Counter(), {}
    for r in mixing.mix(docs(spark, rows)).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


# --- toxicity and quality -----------------------------------------------------------------------------------------


def _auc(rows, labels, name):
    pairs = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    toxic = toxicity.op2_toxicity(spark, sf_dir).collect()
    good = quality.op4_quality(spark, sf_dir).collect()
    assert _auc(toxic, {r["doc_id"]: r["toxic"] for r in rows}, "toxic") > 0.95
    assert _auc(good, {r["doc_id"]: r["quality"] for r in rows}, "quality") > 0.99
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in toxic)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in good)

    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in toxic)


def test_factorization_learns_a_pair():
    """Two terms that are harmless alone and toxic together: no linear weights can tell."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (4000, 2))
    y = (x[:, 0] ^ x[:, 1] ^ 1).astype(float)
    lists = [[k for k in (0, 1) if row[k]] for row in x]
    indptr = np.concatenate([[0], np.cumsum([len(r) for r in lists])])
    model = toxicity.fit(indptr, np.array([i for r in lists for i in r]), y, 2)
    assert model["v"][0] @ model["v"][1] > 1


def test_training_learns_pairs_of_terms_that_differ_by_no_class(spark):
    """Through train() and score(): terms of small |z| alone, toxic together or apart, among other words."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (4000, 2))
    texts = [" ".join([*(w for w, k in zip(("one", "two"), row, strict=True) if k), f"other{rng.integers(50)}"]) for row in x]
    y = [int(row[0] == row[1]) for row in x]
    labels = spark.createDataFrame([(i, 0, k) for i, k in enumerate(y)], "doc_id bigint, quality int, toxic int")
    d = docs(spark, list(enumerate(texts)))
    out = toxicity.score(d, toxicity.train(d, labels)).select("doc_id", "predicted").collect()
    held = [r for r in out if crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in held]) > 0.99


def test_quality_against_brute_force(spark):
    """Scores of all documents by the densities written out, with covariances of the labelled rows by numpy."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    x = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    known = [(x[i], y) for i, y in labels.items() if i in x and crc32(str(i).encode()) % 5 != 0]
    by = {c: np.stack([v for v, y in known if y == c]) for c in (0, 1)}
    cov = {c: np.cov(v.T, bias=True) for c, v in by.items()}
    pooled = sum(len(by[c]) * cov[c] for c in by) / len(known)

    def density(v, c):
        m = (1 - quality.POOL) * cov[c] + quality.POOL * pooled
        m = (1 - quality.DIAGONAL) * m + quality.DIAGONAL * np.diag(np.diag(m)) + 1e-4 * np.eye(len(m))
        d = v - by[c].mean(0)
        return math.log(len(by[c]) / len(known)) - 0.5 * np.linalg.slogdet(m)[1] - 0.5 * d @ np.linalg.inv(m) @ d

    for r in quality.op4_quality(spark, MIDDLE).collect():
        odds = np.clip(density(x[r["doc_id"]], 1) - density(x[r["doc_id"]], 0), -500, 500)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-6)
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_toxicity_against_brute_force():
    """The score of a text by the machine's formula, every pair of its terms written out."""
    rng = np.random.default_rng(8)
    index = np.full(toxicity.BUCKETS, -1, np.int32)
    words = [f"w{k}" for k in range(12)]
    at = [toxicity.term_buckets(w, {}).pop() for w in words]
    index[at] = np.arange(12)
    model = {"index": index, "b": -0.3, "w": rng.normal(size=12), "v": rng.normal(size=(12, 5))}
    texts = ["", None, "unknown words", "w1", "w1 w2 W2, w7 w11 other", " ".join(words)]
    want = []
    for t in texts:
        terms = sorted({index[b] for b in toxicity.term_buckets(t, {})} - {-1})
        z = model["b"] + sum(model["w"][i] for i in terms) + sum(model["v"][i] @ model["v"][j] for i in terms for j in terms if i < j)
        want.append(1 / (1 + math.exp(-z)))
    assert toxicity.scores(texts, model, {}) == pytest.approx(want)


def test_scores_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 1, 1), (6, 1, 0), (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    for labels_ in (labels, labels.limit(0)):
        d = docs(spark, ODD)
        toxic = toxicity.score(d, toxicity.train(d, labels_))
        assert toxic.count() == len(ODD) and toxic.filter("score is null or predicted is null").isEmpty()
        stats = quality.document_statistics(d)
        good = quality.score(stats, quality.fit(stats, labels_)).collect()
        assert sorted(str(r["doc_id"]) for r in good) == sorted(str(r[0]) for r in ODD)
        assert all(0 <= r["score"] <= 1 for r in good)
    none = docs(spark, [])
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert quality.document_statistics(none).count() == 0


# --- decontamination ----------------------------------------------------------------------------------------------


def _hits(text, items):
    """Brute force: (n_words, hit positions, items)."""
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    w, hit, which = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(len(b), 13)
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                which.add(str(item))
    return len(w), len(hit), ",".join(sorted(which)), len(which)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(6)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([1, 3, 3, 12, 13, 14, 30, 0, 20])] + [(90, None), (91, "Ä-1 b c"), (6, "w0 w0 w1")]
    texts = [(1000 + k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(40)]
    texts += [(100 + k, f"x y {t} z") for k, (_, t) in enumerate(items)] + [(r[0], r[1]) for r in ODD if r[0] not in (None, 6)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in winnowing.decontaminate(docs(spark, texts), bench).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        n, hit, which, m = _hits(t, items)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, m), i
        assert r["items_sha256"] == hashlib.sha256(which.encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_decontamination_empty_sides(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    out = winnowing.decontaminate(docs(spark, ODD), none).collect()
    assert len(out) == len(ODD) and not any(r["contaminated"] for r in out)
    assert winnowing.decontaminate(docs(spark, []), none).collect() == []


# --- secrets ------------------------------------------------------------------------------------------------------


def test_base_spans():
    text = "Password = 'abcdefgh' AKIAABCDEFGHIJKL0 " + "0123456789abcdef" * 2 + " token: short api_key=0123456789"
    base, found = secrets.all_spans(text)
    named = [secrets.KINDS[k] for _, k, _ in base]
    assert named == ["assign", "access", "hex", "assign"]
    assert text[base[0][0] : base[0][2]] == "Password = 'abcdefgh"
    assert set(base) <= set(found)


def test_long_s_is_no_letter_of_a_keyword():
    assert secrets.base_spans("paſſword=abcdefgh12") == []


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: quote(s, safe=""),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(),
        lambda s: base64.b64encode(gzip.compress(s.encode(), mtime=0)).decode(),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: quote(base64.b64encode(s.encode()).decode() + "%", safe=""),
    ],
)
def test_nested_layers(wrap):
    secret = "password=Zx81kfQp02mmAA"
    text = f"é before {wrap(secret)} after"
    base, found = secrets.all_spans(text)
    assert base == [] and any(k == 0 for _, k, _ in found)
    assert "after" in secrets.redact(text, found) and wrap(secret) not in secrets.redact(text, found)


def test_spans_of_layers_are_mapped():
    text = "x=%20y&password%3DZx81kfQp02mmAA&plain=1 \\u0070assword=Zx81kfQp02mmAB"
    base, found = secrets.all_spans(text)
    assert base == []
    assert {text[s:e] for s, _, e in found} == {"password%3DZx81kfQp02mmAA", "\\u0070assword=Zx81kfQp02mmAB"}
    # What a run holds in clear keeps its own span.
    clear = "a%20b&password=Zx81kfQp02mmAA"
    assert secrets.all_spans(clear)[1] == secrets.base_spans(clear) == [(6, 0, 29)]
    # Escapes that are no UTF-8 hide nothing.
    assert [k for _, k, _ in secrets.all_spans("%ff%00&passwor%64=Zx81kfQp02mmAA")[1]] == [0]


@pytest.mark.parametrize(
    "text",
    [
        "password\\u003dhunter2hunter2",
        "pass\\u0077ord=hunter2hunter2",
        "AK\\u0049AABCDEFGHIJKLMNOP",
        "\\u0070assword = hunter2hunter2",
        "password: \\u0022hunter2hunter2",
        "password = %22hunter2hunter2",
        "password: hunter%32hunter2",
        "passwor\\x64%20%3d hunter2hunter2",
    ],
)
def test_findings_reach_over_escapes(text):
    """The text on both sides of an escape belongs to its layer."""
    base, found = secrets.all_spans(f"é% {text} after")
    assert base == [] and [(s, e) for s, _, e in found] == [(3, 3 + len(text))]


def _base64(raw, width=0):
    text = base64.b64encode(raw).decode()
    return "\n".join(text[k : k + width] for k in range(0, len(text), width)) if width else text


SECRET = b"password=Zx81kfQp02mmAA"


@pytest.mark.parametrize(
    "run",
    [
        "dG9rZW49YWJjZDEyMzQ=",
        _base64(b"some words before the line break, token" + b" " * 14 + SECRET + b" more", 76),
        _base64(b"some words before the line break, token" + b" " * 14 + SECRET + b" more", 76).replace("\n", "\r\n  "),
        _base64(gzip.compress(b" ".join(hashlib.sha512(bytes([k])).digest() for k in range(40)) + SECRET, mtime=0), 64),
        _base64(gzip.compress(b"clean", mtime=0) + gzip.compress(SECRET, mtime=0)),
        _base64(bz2.compress(b"clean") + bz2.compress(SECRET)),
        _base64(lzma.compress(b"clean") + lzma.compress(SECRET)),
        _base64(zlib.compress(b"clean") + b"\0" + zlib.compress(SECRET)),
        _base64(zlib.compress(b"clean") + SECRET),
        _base64(zlib.compress(SECRET + b" and more words than these")[:-1] + b"\0"),
        _base64(b"\xff\xfe" + SECRET),
        _base64(SECRET + b"\0"),
        _base64(zlib.compress(b"0" * 32, 9)),
        base64.urlsafe_b64encode(b"words before it: " * 2 + b"~~~>>>???" + SECRET).decode(),
    ],
)
def test_base64_is_read_whole(run):
    text = f"é before:\n{run}\n; after"
    base, found = secrets.all_spans(text)
    assert base == [] and (10, 10 + len(run)) in {(s, e) for s, _, e in found}
    assert secrets.redact(text, found) == "é before:\n[SECRET]\n; after"


def test_words_around_wrapped_base64():
    """The block is found between lines of other widths, and with a first line of another width."""
    wrapped = _base64(b"some words before the line break, token" + b" " * 14 + SECRET + b" more", 76)
    text = f"see\nbelow\n{wrapped}\nafter\nit"
    assert (10, 0, 10 + len(wrapped)) in secrets.all_spans(text)[1]
    text = f"Basic: {wrapped[:60]}\n {wrapped[60:].replace(chr(10), '')}"
    assert (7, 0, len(text)) in secrets.all_spans(text)[1]


def test_every_copy_of_a_nested_layer_is_found():
    wrapped = "password=Zx81kfQp02mmAA"
    for _ in range(12):
        wrapped = base64.b64encode(wrapped.encode()).decode()
    text = f"{wrapped} and {wrapped}"
    assert secrets.all_spans(text)[1] == [(0, 0, len(wrapped)), (len(wrapped) + 5, 0, len(text))]


def _big(secret=SECRET, words=400_000):
    return base64.b64encode(gzip.compress(b"word " * words + secret + b" and " + b"word " * words, mtime=0)).decode()


@pytest.mark.parametrize("wrap", [lambda t: t, lambda t: base64.b64encode(gzip.compress(t.encode())).decode(), lambda t: base64.b64encode(bz2.compress(lzma.compress(base64.b64decode(t)))).decode()])
def test_data_beyond_the_allowance_are_read_in_windows(monkeypatch, wrap):
    monkeypatch.setattr(secrets, "WINDOW", 1 << 16)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 12)
    text = wrap(_big())
    for room in (1 << 26, 1 << 20, 1 << 16):
        tight = secrets.Unpacker(room)
        assert secrets.all_spans(text, tight)[1] == [(0, 0, len(text))] and tight.cut == 0 and tight.refused == []


def test_what_may_not_be_read_is_counted_and_redacted():
    big = _big()
    text = " , ".join([big] * 9)
    room = secrets.Unpacker(5 << 20)
    assert len(secrets.all_spans(text, room)[1]) == 9 and room.cut == 0 and room.refused == []
    tight = secrets.Unpacker(1 << 20, 1 << 20)
    found = secrets.all_spans(text, tight)[1]
    assert found == [] and secrets.redact(text, tight.refused) == " , ".join(["[SECRET]"] * 9)
    nested = base64.b64encode(big.encode()).decode()
    tight = secrets.Unpacker(1 << 20, 1 << 20)
    assert secrets.all_spans(f"a {nested} b", tight)[1] == [] and tight.refused == [(2, secrets.REFUSED, 2 + len(nested))]
    tight = secrets.Unpacker(10)
    text = "clear\n\\u0070assword = hunter2hunter2\n; clear"
    assert secrets.all_spans(text, tight)[1] == [] and secrets.redact(text, tight.refused) == "clear\n[SECRET]\n; clear"


def test_compressed_data_in_url_escapes():
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        run = "".join(f"%{b:02X}" if not chr(b).isalnum() or b > 127 else chr(b) for b in pack(b"words " * 9 + SECRET))
        text = f"see data={run} end"
        assert (4, 0, 9 + len(run)) in secrets.all_spans(text)[1]


@pytest.mark.parametrize("text", ["\\u{70}assword=hunter2hunter2", "\\U00000070assword=hunter2hunter2", "\\u{000070}assword\\u{3d}hunter2hunter2"])
def test_long_forms_of_unicode_escapes(text):
    assert [(s, e) for s, _, e in secrets.all_spans(f"a {text} \\u{{110000}}")[1]] == [(2, 2 + len(text))]


@pytest.mark.parametrize(
    "text",
    [
        "a" * 10**6 + " 5% off",
        "abc-def-" * 130_000 + "%41",
        "%" * 10**6,
        "x%9C" * 250_000,
        "QUJD" * 250_000 + "!",
        "\\u0041" * 170_000,
        "a\n" * 500_000,
        "password" * 125_000,
        "0123456789abcdef " * 60_000,
    ],
)
def test_a_million_characters_take_no_long_time(text):
    began = time.process_time()
    secrets.all_spans(text)
    assert time.process_time() - began < 6


def test_base_columns_against_sql(spark):
    """Counts of all documents, and the positions of all base findings by another implementation."""
    got = {r["doc_id"]: r for r in secrets.op5_secrets(spark, MIDDLE).collect()}
    sql = r"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: length(v) >= 8)) AS a,
      len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 16)) AS k, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda v: length(v) >= 32)) AS h FROM documents"""
    want = duck(MIDDLE).sql(sql).fetchall()
    assert len(want) == len(got) and sum(w[1] + w[2] + w[3] for w in want) > 0
    assert all((got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == (a, k, h) for i, a, k, h in want)
    for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect():
        found = []
        for n, (pattern, group, least) in enumerate([(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), (r"AKIA[A-Z0-9]+", 0, 16), (r"[0-9a-f]+", 0, 32)]):
            found += [(m.start(), n, m.end()) for m in re.finditer(pattern, r["text"], re.ASCII) if len(m[group]) >= least]
        named = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
        assert {*named.split(",")} - {""} <= {*got[r["doc_id"]]["spans"].split(",")}


def test_secret_cycles_end_and_words_are_left_alone(spark):
    assert secrets.all_spans("%25" * 40 + " " + "QUJD" * 30)[1] == []
    out = secrets.scan(docs(spark, [*ODD, (8, "AKIAABCDEFGHIJKL0")])).select("doc_id", "found.*").collect()
    assert len(out) == len(ODD) + 1
    assert [r["spans"] for r in out if r["doc_id"] == 8] == ["access:0:17"] and sum(r["spans"] != "" for r in out) == 1
    assert secrets.scan(docs(spark, [])).count() == 0


# --- language model -----------------------------------------------------------------------------------------------


def test_forward_and_counts_against_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    s, v = 2, 3
    norm = lambda x, axis=-1: x / x.sum(axis, keepdims=True)
    model = {"start": norm(rng.random(s)), "move": norm(rng.random((s, s))), "emit": norm(rng.random((v, s)), 0)}
    seqs = [np.array(x) for x in ([0, 1, 2, 2], [1], [2, 0])]
    emits, moves, starts = np.zeros((v, s)), np.zeros((s, s)), np.zeros(s)
    want = []
    for seq in seqs:
        total, paths = 0.0, []
        for code in range(s ** len(seq)):
            path = [code // s**k % s for k in range(len(seq))]
            p = model["start"][path[0]] * model["emit"][seq[0], path[0]]
            for k in range(1, len(seq)):
                p *= model["move"][path[k - 1], path[k]] * model["emit"][seq[k], path[k]]
            total += p
            paths.append((path, p))
        want.append(math.log10(total))
        for path, p in paths:
            starts[path[0]] += p / total
            for k, state in enumerate(path):
                emits[seq[k], state] += p / total
                if k:
                    moves[path[k - 1], state] += p / total
    assert hmm.log10_likelihood(seqs, model) == pytest.approx(want)
    for block in (2_000_000, 3, 1):
        monkeypatch.setattr(hmm, "BLOCK", block)
        got = hmm.expected_counts(seqs, model)
        assert got["emit"] == pytest.approx(emits, abs=1e-5) and got["move"] == pytest.approx(moves, abs=1e-5) and got["start"] == pytest.approx(starts, abs=1e-5)
        assert got["log"] == pytest.approx(sum(want), abs=1e-5)
    every = [np.array(x) for x in product(range(v), repeat=4)]
    assert (10 ** hmm.log10_likelihood(every, model)).sum() == pytest.approx(1)


def test_scores_are_probabilities(spark, monkeypatch):
    """With one unknown token to each class, all texts of two words and all that begin with the end sum to the start."""
    monkeypatch.setattr(hmm, "CLASSES", 2)
    monkeypatch.setattr(hmm, "OWN", 2)
    known = ["a", "b", "c", "d"]
    unknown = {hmm.class_of(w.encode()): w for w in map(str, range(20))}
    words = [*known, *unknown.values()]
    texts = [(k, f"{x} {y}") for k, (x, y) in enumerate(product(words, repeat=2))] + [(k + 100, w) for k, w in enumerate(words)] + [(200, "")]
    train = [(300 + k, t) for k, t in enumerate(["a b a b c", "b a d", "a a a b", ""])]
    df = spark.createDataFrame([(i, t, i < 300) for i, t in texts + train], "doc_id bigint, text string, held_out boolean")
    got = {r["doc_id"]: 10 ** r["score"] for r in hmm.score(df).collect()}
    two, one, none = (sum(got[i] for i, _ in texts if lo <= i < lo + 100) for lo in (0, 100, 200))
    assert 0 < two and 0 < one and 0 < none and two + one + none < 1
    # One more word of any kind or the end: a word w is as likely as all that may follow it.
    first = {}
    for k, (x, _) in enumerate(product(words, repeat=2)):
        first[x] = first.get(x, 0.0) + got[k]
    assert all(first[w] + got[100 + k] < 1 for k, w in enumerate(words))


def _base(texts, held):
    counts = Counter()
    for t, h in zip(texts, held, strict=True):
        if not h:
            counts.update([*hmm.tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    return [(len(hmm.tokens(t)) + 1, sum(counts[w] > 0 for w in [*hmm.tokens(t), None]), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*hmm.tokens(t), None])) for t in texts]


@pytest.mark.parametrize("limits", [(16_000, 200_000), (3, 5)])
def test_language_model_against_brute_force(spark, monkeypatch, limits):
    """The small limits send most tokens through classes and the join."""
    monkeypatch.setattr(hmm, "OWN", limits[0])
    monkeypatch.setattr(hmm, "COMMON", limits[1])
    texts = ["a b c a\tb", "A B unknown\x0bwords", "É é a", "", None, "c c c c d e f g", "a b c a\tb", "x y z a b"]
    held = [False, True, False, False, True, False, False, False]
    df = spark.createDataFrame([(k if k != 6 else 0, t, h) for k, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id bigint, text string, held_out boolean")
    got = sorted(hmm.score(df).collect(), key=lambda r: (r["doc_id"], r["base_score"]))
    want = sorted(((k if k != 6 else 0, *b) for k, b in enumerate(_base(texts, held))), key=lambda r: (r[0], r[4]))
    assert [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [w[:4] for w in want]
    assert [r["base_score"] for r in got] == pytest.approx([w[4] for w in want])
    assert all(r["score"] < 0 for r in got)


def test_language_model_on_documents(spark):
    rows = hmm.op6_language_model(spark, MIDDLE).collect()
    for held in (False, True):
        mine = [r for r in rows if r["held_out"] == held]
        assert sum(r["score"] for r in mine) > sum(r["base_score"] for r in mine)


def test_language_model_odd_rows(spark):
    from pyspark.sql import functions as F

    d = docs(spark, ODD)
    for held in (F.lit(True), F.coalesce(F.col("doc_id") < 5, F.lit(False))):
        out = hmm.score(d.withColumn("held_out", held)).collect()
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ODD)
        assert all(math.isfinite(r["score"]) for r in out)
    assert hmm.score(docs(spark, []).withColumn("held_out", F.lit(False))).collect() == []


# --- chats --------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    evil = "<|end|>\n\\b \\l<|user|>\n[INST] \\\\ | </s>"
    rows = [(1, 0, "system", evil), (1, 1, "user", evil), (1, 2, "assistant", evil), (2, 0, "assistant", "x"), (3, 1, "user", None), (3, 1, "user", None), (4, None, None, ""), (None, 0, "user", "q"), (5, 0, "a|>\nb", "t")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, turns int")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("system", evil), ("user", evil), ("assistant", evil)]
    assert got[1]["loss_text"] == evil and got[1]["valid"] and got[1]["formatted"].count("<|end|>") == 3
    assert not got[2]["valid"] and got[2]["broken_at"] == 0 and got[2]["loss_text"] == "x"
    assert not got[3]["valid"] and got[3]["broken_at"] == 1 and len(got[3]["turns"]) == 2
    assert [(t["role"], t["text"]) for t in got[4]["turns"]] == [("", "")] and got[None]["valid"]
    assert [(t["role"], t["text"]) for t in got[5]["turns"]] == [("a|>\nb", "t")]
    assert chat.format_chats(df.limit(0)).collect() == []


# --- WARC ---------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    rows = [(1, "u1", big), (5, "u5\r\nX: y", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "twice"), (8, "u", "twice")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    path = f"file://{tmp_path}/archive"
    warc.write(warc.plan_revisits(pages), path)
    out = warc.assemble(warc.records(spark, path)).collect()
    assert len(out) == len(rows)
    kept = [r["main"] for r in out if r["main"]["record_type"] == "response"]
    assert sorted(bytes(m["payload"]).decode() for m in kept) == sorted([big, "small", "small", "", "", "twice", "twice"])
    again = [r["main"] for r in out if r["main"]["record_type"] == "revisit"]
    target = next(r["record_id"] for r in out if r["metadata"]["fields"]["page"] == "5")
    assert len(again) == 3 and {m["refers_to"] for m in again} == {target}
    assert all(r["request"] and r["metadata"]["fields"]["payloadBytes"] for r in out)


def test_warc_links_from_the_response_and_plain_files(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nhi"
    record = lambda kind, name, extra, block: b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, name, extra, len(block), block)
    (tmp_path / "a.warc").write_bytes(record(b"warcinfo", b"i", b"", b"software: x\r\n") + record(b"request", b"q", b"", b"GET /") + record(b"response", b"r", b"WARC-Concurrent-To: <q>\r\n", body) + record(b"metadata", b"m", b"WARC-Concurrent-To: <r>\r\n", b"a: b\r\n"))
    (row,) = warc.assemble(warc.records(spark, f"file://{tmp_path}")).collect()
    assert row["request"]["record_id"] == "<q>" and row["metadata"]["fields"] == {"a": "b"} and bytes(row["main"]["payload"]) == b"hi"


# --- near duplicates ----------------------------------------------------------------------------------------------


def _naive(a, b):
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in a if i in b)


def test_probability_jaccard_against_definition():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sets = [dict(zip(*[x.tolist() for x in np.unique(rng.integers(0, 12, 15), return_counts=True)], strict=True)) for _ in range(2)]
        arrays = [(np.array(list(s), np.uint64), np.array(list(s.values()), float)) for s in sets]
        assert probminhash.probability_jaccard(*arrays) == pytest.approx(_naive(*sets))


def test_signatures_estimate_it():
    rng = np.random.default_rng(4)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = (e[:250], rng.integers(1, 4, 250).astype(float)), (e[50:], rng.integers(1, 4, 250).astype(float))
    sig = probminhash.signatures([a, b, (e[:0], np.zeros(0)), (e[:1], np.ones(1))], 2048)
    assert (sig[0] == sig[1]).mean() == pytest.approx(probminhash.probability_jaccard(a, b), abs=0.05)
    assert (sig[2] == 0).all() and (sig[3] == e[0]).all()


@pytest.mark.parametrize("chunk", [512, 8])
def test_near_duplicates_against_brute_force(spark, monkeypatch, chunk):
    """Groups of copies without a centre, copies of copies, and passages that many share; also with tiny chunks."""
    monkeypatch.setattr(probminhash, "CHUNK", chunk)
    monkeypatch.setattr(probminhash, "BLOCK", chunk)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    shared = [word() for _ in range(40)]
    rows = []
    for _ in range(6):
        chain = [word() for _ in range(120)]
        for _ in range(25):
            rows.append(list(chain))
            if rng.random() < 0.7:
                chain = list(chain)
            for _ in range(rng.randint(1, 2)):
                chain[rng.randrange(len(chain))] = word()
    rows += [[word() for _ in range(60)] + shared + [word() for _ in range(rng.randint(0, 40))] for _ in range(60)]
    rows += [["short"], ["short"], ["a", "b", "c"], ["a", "b", "d"]]
    texts = [(k, " ".join(r)) for k, r in enumerate(rows)]
    words = probminhash._Words()
    sets = [probminhash.shingles(t, words)[:2] for _, t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            if len(np.intersect1d(sets[i][0], sets[j][0])) and probminhash.probability_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {k: root(k) for k in range(len(texts))}


def test_near_duplicates_odd_rows(spark):
    out = probminhash.near_duplicates(docs(spark, ODD)).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in out) == sorted((str(r[0]), str(r[0])) for r in ODD)
    assert probminhash.near_duplicates(docs(spark, [])).collect() == []
    same = probminhash.near_duplicates(docs(spark, [(9, "One two, three"), (3, "one TWO three!"), (None, "one two three")])).collect()
    assert {r["class_id"] for r in same} == {3}


# --- fingerprints -------------------------------------------------------------------------------------------------


def test_fingerprints_against_brute_force(spark):
    from pyspark.sql import functions as F

    rows = docs(spark, [*[r for r in ODD], (11, LONG + " end"), (12, "tie tie tie")])
    got = simhash.add_fingerprints(rows, {"text": "fingerprint"}).select("doc_id", "text", "fingerprint").collect()
    terms = rows.select("text", F.split(F.coalesce("text", F.lit("")), simhash.SPACES).alias("w")).select("text", F.filter("w", lambda w: w != "").alias("w"))
    pairs = terms.select("text", F.transform("w", lambda w, i: F.xxhash64(w, F.get("w", i + 1))).alias("h"), F.size("w").alias("n")).collect()
    want = {}
    for r in pairs:
        h = np.array(r["h"][: max(1, r["n"] - 1)] if r["n"] else [], np.int64).view(np.uint64)
        number = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
        want[r["text"]] = f"{number:016x}"
    assert all(r["fingerprint"] == want[r["text"]] for r in got)


@pytest.mark.parametrize("run", [1000, 1])
def test_edited_texts(spark, monkeypatch, run):
    rows = [(5, "abcdefgh"), (1, "xy"), (9, None), (30, "12345678"), (2**61, "far"), (None, "none"), (5, "abc")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(simhash, "RUN", run)
    got = {(r["doc_id"], r["text"]): r["next_text"] for r in simhash.with_next(d).collect()}
    assert got == {(None, "none"): "xy", (1, "xy"): "abc", (5, "abc"): "abcdefgh", (5, "abcdefgh"): "", (9, ""): "12345678", (30, "12345678"): "far", (2**61, "far"): "none"}
    assert simhash.with_next(d.limit(0)).collect() == []
    odd = simhash.with_next(docs(spark, ODD))
    assert odd.count() == len(ODD)


@pytest.mark.parametrize("level", [2, 4])
def test_runs_do_not_follow_the_range_of_ids(spark, monkeypatch, level):
    """One id far off all others: the rows still fall into runs of a few, and every row is followed by the next."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "RUN", 10)
    monkeypatch.setattr(simhash, "LEVEL", level)
    ids = [*range(-30, 250, 2), 2**61]
    d = spark.createDataFrame([(i, f"text {i}") for i in ids[::-1]], "doc_id bigint, text string")
    runs = Counter(r[0] for r in d.select(simhash._run_of(F.col("doc_id"), simhash._bounds(d))).collect())
    assert len(runs) >= min(level**3, 14) - 1 and max(runs.values()) <= 3 * len(ids) / len(runs)
    got = {r["doc_id"]: r["next_text"] for r in simhash.with_next(d).collect()}
    assert got == {i: f"text {j}" for i, j in zip(ids, [*ids[1:], ids[0]], strict=True)}


def test_fingerprint_columns_may_clash(spark):
    d = spark.createDataFrame([("a b c", 1, 2, 3, "x")], "text string, _words int, _v0 int, _n int, f string")
    out = simhash.add_fingerprints(d, {"text": "f"})
    assert sorted(out.columns) == sorted(d.columns) and out.first()["_n"] == 3


def test_fingerprint_query(spark):
    source = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in simhash.op10_fingerprint(spark, SMALL).collect()}
    for k, (i, t) in enumerate(source):
        after, q = source[(k + 1) % len(source)][1], len(t) // 4
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()
        near = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
        assert got[i]["near_edited"] == near(got[i]["fingerprint"], got[i]["edited_fingerprint"])
        assert got[i]["near_next"] == near(got[i]["fingerprint"], got[source[(k + 1) % len(source)][0]]["fingerprint"])
        within = sum((int(got[i]["fingerprint"], 16) ^ int(r["fingerprint"], 16)).bit_count() <= simhash.RADIUS for r in got.values()) - 1
        assert got[i]["n_near"] == (within if i % 20 == 0 else None)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.95


def test_radius_search_against_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = [(k, b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 6)))) for k, b in enumerate(base * 10)]
    df = spark.createDataFrame([(k, f"{n:016x}") for k, n in prints] + [(999, None)], "doc_id bigint, fingerprint string")
    for radius in (0, 3, 5):
        got = {(r[0], r[1]): r[2] for r in simhash.within_radius(df.withColumnRenamed("doc_id", "query_id"), df, radius).collect()}
        want = {(i, j): (a ^ b).bit_count() for i, a in prints for j, b in prints if i != j and (a ^ b).bit_count() <= radius}
        assert got == want

"""Periodic runs, the line CRF and whitening on small tables with nulls, empty and long texts, ties, repeated
rows, empty tables and columns of clashing names, against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from mercato.llm import linecrf, periodic, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# clashing names: columns that the operators make or use themselves
CLASH = "doc_id long, text string, h long, runs string, score double, y int, bins string, whitened string, n_words int"


def rows_of(texts):
    return [(i, t, 7, "x", 0.5, 1, "b", "w", 3) for i, t in texts]


# ------------------------------------------------------------------------------------------------- runs
def brute_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i:
                stretch = words[i : j + q]
                smallest = next(d for d in range(1, q + 1) if all(a == b for a, b in zip(stretch, stretch[d:])))
                if smallest == q and len(stretch) >= max(6, 4 * q):
                    out.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def tailed(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def test_runs_of_words_at_random():
    rng = np.random.default_rng(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.integers(0, 5)):
            words = rng.integers(0, rng.integers(1, 5), rng.integers(0, 50))
            if rng.random() < 0.6 and len(words) > 2:
                a, p = rng.integers(0, len(words)), rng.integers(1, 9)
                words[a:] = np.resize(words[a : a + p], len(words) - a)
            texts.append(words)
        at = np.append(0, np.cumsum([len(x) for x in texts])).astype(np.int64)
        flat = np.concatenate([np.zeros(0, int), *texts]).astype(np.int64)
        want = [(s + at[i], n, q) for i, x in enumerate(texts) for s, n, q in brute_runs(x.tolist())]
        assert list(zip(*(x.tolist() for x in periodic.find_runs(flat, at)))) == want


def test_periodic_runs(spark):
    tenth = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:6]  # these get a periodic tail
    other = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10][:14]
    prose = " ".join(f"w{i * i % 97}" for i in range(300))
    texts = [
        (other[0], None), (other[1], ""), (other[2], " \n\t"), (other[3], "a a a a a a"), (other[4], "a a a a a"), (other[5], "a b " * 4),
        (other[6], "x " * 9 + "y y y y y y z"), (other[7], "a b a b a b a b a a a a a a"), (other[8], "ÄÖ  ÄÖ\nÄÖ\x0bÄÖ\x0cÄÖ\rÄÖ end"),
        (other[9], prose), (other[9], prose), (None, "n n n n n n n"), (other[10], ("p q r s t " * 5 + prose + " ") * 4), (other[11], "k " * 30_000),
        (other[12], " ".join(str(i % 1009) for i in range(12_000))), (other[13], "one two three"),
        *[(i, prose + f" {k}") for k, i in enumerate(tenth[:4])], (tenth[4], "one"), (tenth[5], None),
    ]
    docs = spark.createDataFrame(rows_of(texts), CLASH).repartition(3)
    got = Counter(map(tuple, periodic.periodic_runs(docs, tails=True).collect()))
    want = []
    for i, t in texts:
        words = tailed(i, WORD.findall(t or ""))
        runs = [(0, 30_000, 1)] if t and len(words) == 30_000 else [(0, 12_000, 1009)] if len(words) == 12_000 else brute_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     *(hashlib.sha256(x.encode()).hexdigest() for x in (said, kept))))
    assert got == Counter(want)
    assert periodic.periodic_runs(docs.limit(0), tails=True).count() == 0
    plain = {r["doc_id"]: r for r in periodic.collapse(docs, ["doc_id", "h"]).collect()}
    assert plain[other[5]]["collapsed"] == "a b" and plain[other[5]]["runs"] == [(0, 8, 2)] and plain[tenth[0]]["runs"] == []


# -------------------------------------------------------------------------------------------------- CRF
def test_forward_backward_counts_every_labelling():
    rng = np.random.default_rng(2)
    lines = [1, 4, 2, 6, 1]
    at = np.append(0, np.cumsum(lines))
    unary, stay_good, stay_bad = rng.standard_normal(at[-1]), 0.7, -0.4
    got = linecrf.forward_backward(unary, at, stay_good, stay_bad)
    for k, n in enumerate(lines):
        u = unary[at[k] : at[k + 1]]
        paths = list(itertools.product((0, 1), repeat=n))
        good = [sum(a and b for a, b in zip(p, p[1:])) for p in paths]
        bad = [sum(not a and not b for a, b in zip(p, p[1:])) for p in paths]
        weight = np.exp([u @ np.array(p) + stay_good * g + stay_bad * b for p, g, b in zip(paths, good, bad)])
        assert np.isclose(got.norm[k], np.log(weight.sum()))
        assert np.allclose(got.good[at[k] : at[k + 1]], (weight / weight.sum()) @ np.array(paths))
        assert np.isclose(got.both_good[k], weight @ good / weight.sum()) and np.isclose(got.both_bad[k], weight @ bad / weight.sum())


def test_line_spans():
    texts = [b"", b"one", b"\n", b"a\nb\n", b"", b"\n\nx"]
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, line_at = linecrf.line_spans(data, at)
    for k, t in enumerate(texts):
        assert [data[s:e].tobytes() for s, e in zip(starts[line_at[k] : line_at[k + 1]], ends[line_at[k] : line_at[k + 1]])] == t.split(b"\n")


def test_gradient_is_the_slope_of_the_loss():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    lines = [3, 1, 5]
    bins = [rng.integers(0, linecrf.BINS - 1, (n, len(linecrf.MEASURES)), dtype=np.uint8) for n in lines]
    batch = pa.RecordBatch.from_pydict({
        "bins": [b.tobytes() for b in bins], "sizes": [np.arange(n, dtype="<i8").tobytes() for n in lines], "y": pa.array([1, 0, 1], pa.int32()),
    })
    w = rng.standard_normal(linecrf.DIMS) * 0.3
    for teacher in (None, rng.standard_normal(linecrf.DIMS)):
        out = linecrf.gradient(batch, w, teacher)
        for k in [*rng.integers(0, linecrf.UNARY, 40), linecrf.UNARY, *([linecrf.UNARY + 1, linecrf.UNARY + 2] if teacher is not None else [])]:
            step = np.zeros(linecrf.DIMS)
            step[k] = 1e-5
            up, down = (linecrf.gradient(batch, w + s, teacher)[linecrf.DIMS] for s in (step, -step))
            assert abs((up - down) / 2e-5 - out[k]) < 1e-6


def test_quality_scores(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("etaoinshr"), rng.integers(2, 8)))
    clean = lambda: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(rng.integers(1, 9)))
    junk = lambda: "\n".join(" | ".join(word().upper() + "!!" for _ in range(10)) for _ in range(rng.integers(1, 9)))
    texts = [(i, clean() if i % 3 else junk()) for i in range(240)]
    odd = [(1000, None), (1001, ""), (None, clean()), (1002, "word " * 60_000), (5, texts[5][1]), (1003, "x\n" * 3000), (1004, junk() + "\n" + clean())]
    docs = spark.createDataFrame(rows_of(texts + odd), CLASH).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(5, 1), (5, None), (None, 0), (9999, 1)], "doc_id long, quality int")
    out = linecrf.quality_scores(docs, labels).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in texts + odd)
    said = {r["doc_id"]: r for r in out}
    for i, t in texts:
        assert said[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and said[i]["predicted"] == int(i % 3 > 0) == int(said[i]["score"] >= 0.7)
        assert said[i]["n_lines"] == t.count("\n") + 1
    assert all(0 <= r["score"] <= 1 for r in out) and said[1000]["score"] == said[1001]["score"] and not said[None]["held_out"]
    assert len({r["score"] for r in out if r["doc_id"] == 5}) == 1
    # labels of the held-out fold decide nothing
    other = labels.withColumn("quality", labels["quality"] * 0).where(linecrf.held_out(labels["doc_id"])).unionByName(labels.where(~linecrf.held_out(labels["doc_id"])))
    assert {(r["doc_id"], r["score"]) for r in linecrf.quality_scores(docs, other).collect()} == {(r["doc_id"], r["score"]) for r in out}
    blank = linecrf.quality_scores(docs, labels.limit(0)).collect()
    assert all(abs(r["score"] - 0.5) < 1e-9 for r in blank) and linecrf.quality_scores(docs.limit(0), labels).count() == 0
    weights = linecrf.fit(linecrf.described_documents(docs, ["doc_id"]), labels)
    lines = {(r["doc_id"], r["line"]): r for r in linecrf.labelled_lines(docs, weights).collect()}
    mixed = odd[-1][1].split("\n")
    assert [lines[1004, k]["bytes"] for k in range(len(mixed))] == [len(x) for x in mixed]
    assert lines[1004, 0]["good"] < 0.5 < lines[1004, len(mixed) - 1]["good"]  # a label goes by line, not by document


# -------------------------------------------------------------------------------------------- whitening
@pytest.mark.parametrize("values", [
    [9.0, 5.0, 2.0, 1.0], [3.0, 3.0, 3.0, 1.0, 1.0], [5.0, 5 - 1e-10, 5 - 2e-10, 4.0, 1e-3, 1e-19], [7.0] * 12, [2.0], [0.0, 0.0],
    list(10.0 ** -np.arange(20)), list(np.linspace(1, 1.1, 40)),
])
def test_leading_eigenvectors(values):
    rng = np.random.default_rng(1)
    d = len(values)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (q * np.array(values)) @ q.T
    v = (v + v.T) / 2
    got, vectors = whitening.leading(v, 8)
    want = np.sort(np.linalg.eigvalsh(v))[::-1][:8]
    assert len(got) == min(8, sum(x > 1e-13 for x in values)) and np.abs(got - want[: len(got)]).max(initial=0) <= 1e-14 * max(values) * d
    assert np.abs(vectors @ vectors.T - np.eye(len(got))).max(initial=0) < 1e-13
    assert np.abs(v @ vectors.T - vectors.T * got).max(initial=0) <= 1e-13 * max(values)


def test_inertia_counts_negative_eigenvalues():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = rng.standard_normal((n := rng.integers(1, 12), n)) * 10.0 ** rng.integers(-3, 3)
        a = a + a.T
        if rng.random() < 0.3:
            np.fill_diagonal(a, 0)  # no pivot on the diagonal
        e = np.linalg.eigvalsh(a)
        if np.abs(e).min() > 1e-10 * np.abs(e).max():
            assert whitening.ldl_inertia(a) == (e < 0).sum()


def test_whitened_embeddings(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((200, 10)) * np.arange(1, 11)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(c) for c in v], "x", 1) for i, v in enumerate(base)]
    rows += [(5, rows[5][1], "x", 1), (None, rows[6][1], "y", 2), (300, None, "", 0), (301, [], "", 0), (302, [nan] * 10, "", 0),
             (303, [inf] + [0.0] * 9, "", 0), (304, [None] + [0.0] * 9, "", 0), (305, [1.0, 2.0], "short", 0), (306, [0.0] * 10, "", 0)]
    used = [r for r in rows if r[0] is None or r[0] not in (300, 301, 302, 303, 304, 305)]
    schema = "vec_id long, embedding array<double>, whitened string, v int"
    table = spark.createDataFrame(rows, schema).repartition(3)
    out = whitening.whitened_embeddings(table).collect()
    x = np.floor(1024 * np.array([r[1] for r in used])).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    want = centred @ vectors / np.sqrt(values)
    assert len(out) == 8 * n and Counter(r["vec_id"] for r in out) == Counter({i: 8 * k for i, k in Counter(r[0] for r in used).items()})
    index = {r[0]: k for k, r in enumerate(used)}
    got = np.zeros((n, 8))
    for r in out:
        k = index[r["vec_id"]]
        got[k, r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["identity_error"] < 1e-10 and int(r["deviation"]) == int(((n * x[k] - sums) ** 2).sum())
        assert abs(r["explained"] - values[r["component"] - 1] / (centred**2).sum() * n) < 1e-12
    got[[k for k in range(n) if k not in index.values()]] = 0  # the first of repeated rows
    rows_of_index = sorted(index.values())
    sign = np.sign((want * got).sum(axis=0))
    assert np.abs(want[rows_of_index] * sign - got[rows_of_index]).max() < 1e-9
    assert whitening.whitened_embeddings(table.limit(0)).count() == 0
    assert whitening.whitened_embeddings(table.where("vec_id = 306")).count() == 0  # one vector varies in nothing
    huge = whitening.whitened_embeddings(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 1e12])], "vec_id long, embedding array<double>"))
    assert huge.where("component = 1").count() == 3 and huge.schema["deviation"].dataType.precision == 38


# --------------------------------------------------------------------------------------------- mixing
def test_the_draws_decide_the_mix(spark):
    from mercato.llm import mixing

    texts = [(i, " ".join(f"d{i}w{k}" for k in range(40 + i % 90))) for i in range(160)]
    docs = spark.createDataFrame([(i, t, f"s{i % 5}", 0) for i, t in texts], "doc_id long, text string, source string, n_chars long")
    one, same, other = (mixing.taken_words(*mixing.mix_sources(docs, 16, size)).collect() for size in (64, 64, 100))
    taken = lambda rows: {r["doc_id"]: (r["taken"], r["first_shard"]) for r in rows}
    assert taken(one) == taken(same) and {i: t for i, (t, _) in taken(one).items()} != {i: t for i, (t, _) in taken(other).items()}
    for rows in (one, other):
        for source in {r["source"] for r in rows}:
            own = [r for r in rows if r["source"] == source]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 16 and all(r["taken"] <= 2 * r["size"] for r in own)


def test_mixed_texts_are_stretches_of_their_documents(spark):
    from mercato.llm import mixing

    texts = {i: "\t".join(f"d{i}w{k} " for k in range(30 + i * 7)) for i in range(40)}
    rows = [(i, t, "ab"[i % 2], 5) for i, t in texts.items()] + [(100, None, "a", 0), (101, " \n", "b", 2), (7, texts[7], "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    mixed = mixing.mixed_documents(docs, 16).collect()
    assert all(r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in mixed)
    whole = mixing.taken_words(*mixing.mix_sources(docs, 16)).collect()
    want = Counter()
    for r in whole:
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in mixed:
        got[r["doc_id"]] += len(r["text"].split())
    assert +got == +want
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------- secrets
def test_entropy_by_window(spark):
    import random

    from mercato.llm import secrets

    rnd = random.Random(11)
    some = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    upper_hex, base36 = some("0123456789ABCDEF", 40), some("abcdefghijklmnopqrstuvwxyz0123456789", 48)
    mixed = some("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", 40)
    blob = some("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 30_000)
    texts = [
        "KEY=" + upper_hex, "id=" + upper_hex, "x " + base36 + " y", some("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 48), "/data/sample/" + mixed,
        "plainwordsthatarejustlongenoughtomatter/" * 3, "EXAMPLE" + mixed[:24], "0" * 60, "550e8400-e29b-41d4-a716-446655440000", mixed + "a" * 80 + mixed[::-1],
        "ä " + blob, "/usr/share/dictionaries/english-words/american-large.txt",
    ]
    out = {r["doc_id"]: r["spans"] for r in secrets.span_digests(secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}

    def brute(text):
        spans = []
        for m in re.finditer(secrets.CANDIDATE, text):
            hot = []
            for i in range(m.start(), m.end() - secrets.WINDOW + 1):
                w = text[i : i + secrets.WINDOW]
                of = next(c for c in secrets.CLASSES if re.search(c[1], w))
                h = -sum(n / len(w) * np.log2(n / len(w)) for n in Counter(w).values())
                if all(re.search(p, w) for p in of[2]) and h >= of[3]:
                    hot.append(i)
            while hot:
                k = next((k for k in range(1, len(hot)) if hot[k] - hot[k - 1] > secrets.WINDOW), len(hot))
                a, b = hot[0], hot[k - 1] + secrets.WINDOW
                if not any(re.search(p, re.sub(r"^([a-z_-]*[/=])+", "", text[a:b])) for p in secrets.ALLOW):
                    spans.append(f"entropy:{a}:{b}")
                hot = hot[k:]
        return spans

    for i, t in enumerate(texts):
        assert [s for s in out[i].split(",") if s.startswith("entropy")] == brute(t), (i, t[:60])
    found = [i for i in range(len(texts)) if "entropy" in out[i]]
    assert {0, 1, 2, 3, 4, 9, 10} <= set(found) and not {5, 7, 8, 11} & set(found)
    assert out[9].count("entropy") == 2 and out[10].endswith(":30002")


# ---------------------------------------------------------------------------------------------- chats
def test_chats_read_back_in_any_order(spark):
    from mercato.llm import chat

    rows = [(c, t, ["user", "assistant"][t % 2], f"turn {t} of {c} \\### Assistant: </turn>") for c in (1, 2, None) for t in range(5)]
    formatted = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = sorted(map(repr, chat.read_back(formatted, ordered=True).collect()))
    assert len(want) == 3 and sorted(map(repr, chat.read_back(formatted.repartition(3)).collect())) == want


# --------------------------------------------------------------------------------------- exact dedup
def test_the_index_decides_and_batches_replace_themselves(spark, tmp_path, monkeypatch):
    from mercato.llm import digest_index

    rows = [(i, f"text {i % 13}" if i % 4 else None) for i in range(60)] + [(None, "text 1"), (59, "text 7"), (59, "text 7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(repr, digest_index.exact_dedup(docs, batches=1).collect()))
    assert sorted(map(repr, digest_index.exact_dedup(docs, batches=3).collect())) == want
    index = digest_index.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    high, low = docs.where("doc_id >= 30"), docs.where("doc_id < 30")
    index.add(high, "b1")
    once = sorted(map(repr, index.add(low, "b2").collect()))
    n = index.entries().count()
    assert sorted(map(repr, index.add(low, "b2").collect())) == once and index.entries().count() == n  # repeated: nothing changes
    assert not any("kept=True" in r and "text" in r for r in once) or len(once) == 30
    # an index that forgets what it got gives other results
    plain = digest_index.DigestIndex.entries
    monkeypatch.setattr(digest_index.DigestIndex, "entries", lambda self: plain(self).where("false"))
    forgetful = digest_index.DigestIndex(spark, f"file://{tmp_path}/other", 4)
    forgetful.add(high, "b1")
    assert sorted(map(repr, forgetful.add(low, "b2").collect())) != once

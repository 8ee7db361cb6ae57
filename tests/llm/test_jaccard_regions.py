"""A group of near copies is one region of the Jaccard join, however many shingles its documents share."""

import itertools

import numpy as np

from mercato.llm import jaccard


def variants(rng, base, count, most):
    for _ in range(count):
        copy = list(base)
        for at in rng.choice(len(base), int(rng.integers(1, most + 1)), replace=False):
            copy[at] = int(rng.integers(10_000, 10**9))
        yield " ".join(map(str, copy))


def similarity(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y), len(x | y)


def components(texts):
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both, either = similarity(texts[a], texts[b])
        if 100 * both >= 80 * either:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return root


def test_near_copies_are_one_region(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = [t for _ in range(2) for t in variants(rng, rng.integers(0, 5000, 150).tolist(), 60, 6)]
    held = []

    def counted(df, name, write=jaccard.materialise):
        out = write(df, name)
        if name in ("jaccard-pivots", "jaccard-pairs"):
            held.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df).collect()}
    assert [out[i] for i in range(len(texts))] == components(texts)
    assert 2 < len(set(out.values())) < len(texts) / 2  # some variants stay alone, so pairs are left after the first pivots
    later = [n for name, n in held if name == "jaccard-pivots"][1:]
    assert later and max(later) <= len(texts)  # not a row for each document and shingle


def test_no_pair_that_links_is_excluded():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))]
    for _ in range(120):
        s = sets[int(rng.integers(0, len(sets)))]
        kept = s[rng.random(len(s)) > rng.random() * 0.15]
        sets.append(np.unique(np.append(kept, rng.integers(0, 2**63, int(rng.integers(1, 20))).astype(np.uint64))))
    shared = [np.array([sum(x in o for o in map(set, sets)) > 1 for x in s]) for s in sets]
    inside = [np.intersect1d(s, sets[0]) for s in sets]
    segment = [((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(jaccard.SEGMENTS) for x in inside]
    table = {
        "n": np.array([len(s) for s in sets]), "own": np.array([int(x.sum()) for x in shared]), "label": np.arange(len(sets)),
        "got": np.array([len(x) for x in inside]), "far": np.array([1 - len(x) / (len(s) + len(sets[0]) - len(x)) for x, s in zip(inside, sets)]),
        "parts": np.array([np.bincount(x.astype(np.int64), minlength=jaccard.SEGMENTS) for x in segment]),
    }
    links = {(i, j) for i, j in itertools.permutations(range(len(sets)), 2) if 100 * len(both := np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - len(both))}
    found = set(zip(*(x.tolist() for x in jaccard.near_pairs(table, table))))
    assert links and links <= found and len(found) < len(sets) * (len(sets) - 1)
    table["far"][::2] = np.nan  # the first pivot wasn't compared with these
    table["parts"][::2], table["got"][::2] = 0, 0
    assert links <= set(zip(*(x.tolist() for x in jaccard.near_pairs(table, table))))

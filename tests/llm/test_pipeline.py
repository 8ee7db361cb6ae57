"""corpus_pipeline.run on a small corpus with ties, nulls, repeats and near copies: each stage against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from mercato.llm import bpe, mixing, packing, toxicity
from mercato.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklm"), 5)) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    rude = [f"rude{k}" for k in range(6)]
    texts = [(i, prose(int(rng.integers(20, 120)))) for i in range(150)]
    toxic = [(200 + i, prose(20) + " " + " ".join(rng.choice(rude, 8)) + " " + prose(10)) for i in range(60)]
    base = prose(60)
    near = [(300, base), (301, base + " one"), (302, "zero " + base), (303, base.upper() + " ONE")]  # 301 and 303 are equal, case aside
    odd = [(400, None), (401, ""), (402, " \n "), (403, "One  word"), (404, "one  WORD"), (405, "one  word"), (5, texts[5][1]), (None, prose(30)), (406, prose(9000))]
    rows = [(i, t, "en", ["a", "b", None, "c"][k % 4], len(t or "")) for k, (i, t) in enumerate(texts + toxic + near + odd)]
    rows += [rows[7], rows[7]]  # whole rows again
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in texts] + [(i, 0, 1) for i, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def rows_of(df):
    return Counter(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in df.collect())


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark, corpus):
    docs = table(spark, corpus, "documents")
    before = rows_of(docs)
    # 1: the rows whose text the fitted classifier scores 0.5 or more go, all others stay
    stage = corpus_pipeline.STAGES[0][1](spark, docs, corpus)
    scores = {}
    model = toxicity.fit(docs, table(spark, corpus, "labels"))
    for r in toxicity.score(docs, model, ["doc_id", "text"]).collect():
        scores[r["text"]] = r["score"]
    want = Counter({r: n for r, n in before.items() if scores[r[1]] < 0.5})
    assert rows_of(stage) == want and stage.columns == docs.columns
    assert sum(200 <= (r[0] or 0) < 260 for r in want) < 5 and sum(n for r, n in want.items() if not 200 <= (r[0] or 0) < 260) > 160
    stage.write.parquet(f"{corpus}/1.parquet")
    # 2: of equal texts the row of largest doc_id
    docs = table(spark, corpus, "1")
    stage = corpus_pipeline.STAGES[1][1](spark, docs, corpus)
    groups = defaultdict(list)
    for r in want:
        groups[(r[1] or "").translate(LOWER)].append(r)
    largest = {k: max(g, key=lambda r: -1 if r[0] is None else r[0])[0] for k, g in groups.items()}
    got = rows_of(stage)
    assert {k: [r[0] for r in got if (r[1] or "").translate(LOWER) == k] for k in largest} == {k: [i] for k, i in largest.items()}
    assert set(got) <= set(want) and set(got.values()) == {1}
    stage.write.parquet(f"{corpus}/2.parquet")
    # 3: of a component of near duplicates the least doc_id
    docs = table(spark, corpus, "2")
    stage = corpus_pipeline.STAGES[2][1](spark, docs, corpus)
    rows = list(got)
    sets = [shingles(r[1]) for r in rows]
    component = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = component[i], component[j]
                component = [min(a, b) if c in (a, b) else c for c in component]
    kept = Counter()
    for c in set(component):
        members = [rows[i] for i in range(len(rows)) if component[i] == c]
        kept[min(members, key=lambda r: (r[0] is None, r[0]))] += 1
    assert rows_of(stage) == kept and len(rows) - len(kept) == 2
    stage.write.parquet(f"{corpus}/3.parquet")
    # 4: stretches of the documents that add up to the words which the mix takes
    docs = table(spark, corpus, "3")
    stage = corpus_pipeline.STAGES[3][1](spark, docs, corpus)
    assert stage.columns == docs.columns
    mixed = stage.collect()
    texts = {r[0]: r for r in kept}
    sizes = {s: sum(len(WORD.findall(r[1] or "")) for r in kept if r[3] == s) for s in {r[3] for r in kept}}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.targets([sizes[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])))
    words, by_source = Counter(), Counter()
    for r in mixed:
        whole = texts[r["doc_id"]]
        assert r["text"] in whole[1] and (r["lang"], r["source"]) == whole[2:4] and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        by_source[r["source"]] += len(WORD.findall(r["text"]))
    assert all(n <= 2 * len(WORD.findall(texts[i][1])) for i, n in words.items())
    for s in order:  # blocks are whole but at a source's end
        assert abs(by_source[s] - target[s]) <= 2 * mixing.TEXT_BLOCK_WORDS
    stage.write.parquet(f"{corpus}/4.parquet")
    # 5: the ids of the mixed texts, once each, in sequences without gaps
    docs = table(spark, corpus, "4")
    tokenizer = Tokenizer.from_file(bpe.tokenizer_path(packing.TOKENIZER))
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            want[r["doc_id"], a, zlib.crc32(ids[a : a + 2048].tobytes()), len(ids[a : a + 2048]), len(ids)] += 1
    packed = corpus_pipeline.STAGES[4][1](spark, docs, corpus).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"], r["length"], r["doc_tokens"]) for r in packed) == want
    filled = defaultdict(list)
    for r in packed:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in filled.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces[:-1]])) and sum(n for _, n in pieces) <= 2048
    assert sorted(filled) == list(range(len(filled)))


def test_run_applies_all_stages(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
    ids = {r["doc_id"] for r in out.collect()}
    assert not ids & {300 + k for k in (2, 3)} and len(ids & set(range(200, 260))) < 5

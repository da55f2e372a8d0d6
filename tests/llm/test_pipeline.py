"""corpus_pipeline: every stage, and run, against plain versions over a small table with nulls, repeats and copies."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sievemark.llm import language_id, mixture, token_count
from sievemark.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(17)
    vocabulary = {"en": ["the", "and", "house", "garden", "with", "king", "which", "though", "that", "thing"], "de": ["das", "und", "haus", "garten", "mit", "könig", "welche", "doch", "schön", "ding"]}
    text = lambda lang, n: " ".join(str(w) + str(x) for w, x in zip(rng.choice(vocabulary[lang], n), rng.choice(list("aeiou"), n), strict=True))
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        rows.append((i, text(lang, int(rng.integers(20, 90))), lang, f"s{i % 3}"))
    item = text("en", 30)
    near = rows[4][1].split()
    near[10] = "changed"
    rows += [(70, rows[3][1], "en", "s0"), (70, rows[3][1], "en", "s0"), (71, " ".join(near), "de", None), (None, rows[5][1], None, None), (None, text("en", 40), "en", "s1")]
    rows += [(72, text("en", 10) + " " + item + " " + text("en", 8), "en", "s2"), (None, item, "en", "s2"), (73, None, "en", "s1"), (74, "", None, "s1"), (75, "123 456", "de", "s0")]
    rows = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    rows.append(rows[0])
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None), (None, "short")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, item


def shingles(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages_and_run(spark, folder):
    path, rows, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name != "token_file":
            docs = written(docs, name)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = [tuple(r) for r in docs.collect()]

    # language ID: what is kept is told with at least one half, and nothing else goes but texts without letters
    model = language_id.train(spark.read.parquet(f"{path}/documents.parquet"), language_id.fold() != 2)
    lang, score = language_id.predict(model, [r[1] for r in rows])
    assert sorted(kept["language_id"], key=str) == sorted((r for r, x, p in zip(rows, lang, score, strict=True) if x != "und" and p >= 0.5), key=str)

    # one row of each class of similar ones, the least (doc_id, nulls last)
    left = kept["language_id"]
    sets, label = [shingles(r[1]) for r in left], list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    classes = {}
    for r, x in zip(left, label, strict=True):
        classes.setdefault(x, []).append(r)
    got = Counter(kept["jaccard_join"])
    assert sum(got.values()) == len(classes) and not got - Counter(left)
    for mine in classes.values():
        stays = [r for r in set(mine) if got[r]]
        assert len(stays) == 1 and got[stays[0]] == 1
        assert (stays[0][0] is None, stays[0][0] or 0) == min((r[0] is None, r[0] or 0) for r in mine)

    # no document with the passage
    assert sorted(kept["decontaminate"], key=str) == sorted((r for r in kept["jaccard_join"] if item not in (r[1] or "")), key=str)
    assert len(kept["decontaminate"]) < len(kept["jaccard_join"])

    # targets met to the word, from words of the documents
    sizes, taken, originals = Counter(), Counter(), {}
    for r in kept["decontaminate"]:
        sizes[r[3]] += len(words(r[1]))
        originals.setdefault(r[0], []).append(words(r[1]))
    for r in kept["mixture"]:
        taken[r[3]] += len(words(r[1]))
        assert r[4] == len(r[1])
        it = [iter(t) for t in originals[r[0]]]
        assert any(all(w in x for w in words(r[1])) for x in it)
    aims = mixture.targets(dict(sizes), (5, 2, 1), 3)
    assert all(abs(taken[s] - aims[s]) <= 1 for s in sizes)

    # ids as the library gives them, in order of doc_id
    library = Tokenizer.from_file(token_count.tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in kept["mixture"]:
        ids = library.encode(r[1], add_special_tokens=False).ids + [0]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((d, n, c) for d, _, n, c in kept["token_file"]) == want
    ends = sorted((s, s + n) for _, s, n, _ in kept["token_file"])
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))

    # run is the chain of the stages
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect()), key=str) == sorted(kept["token_file"], key=str)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

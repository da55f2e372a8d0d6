"""The llm operators against plain versions, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from sievemark.llm import decontaminate, fingerprint, jaccard_join, language_id, mixture, personal_data, substring_dedup, token_count, token_file, toxicity
from sievemark.llm.common import connected_components, written
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, node string, row string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    base, passage = text(120), text(70)
    near = base.split()
    near[60] = "changed"
    out = [base, base, " ".join(near), text(30) + " " + passage, passage + " " + text(90), text(3000), "", None, "one", "one two", text(5), "é x\tA\n\nb"]
    made = [(i, t, "en" if i % 2 else "de", f"s{i % 3}" if i % 5 else None, "n", "r") for i, t in enumerate(out)]
    return [*made, made[3]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_token_count(docs, empty, rows):
    library = Tokenizer.from_file(token_count.tokenizer_path("word_bpe_49k.json"))
    got = token_count.count_tokens(docs).collect()
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows}
    assert len(got) == len(rows) and all(r["n_tokens"] == want[r["doc_id"]] for r in got)
    assert token_count.count_tokens(empty).count() == 0
    odd = ["<|endoftext|>hi", "ΟΔΟΣ", "a\x1cb", "x" * 5000, "I'll IT'S 123"]
    assert token_count.word_bpe(token_count.tokenizer_path("word_bpe_49k.json")).count(odd) == [len(library.encode(t, add_special_tokens=False).ids) for t in odd]


def test_token_file_round_trip(docs, empty, rows):
    library = Tokenizer.from_file(token_count.tokenizer_path("byte_bpe_50k.json"))
    got = token_file.encode_and_read(docs).orderBy("start").collect()
    at = 0
    for r, (i, t, *_) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_file.encode_and_read(empty).count() == 0


@pytest.mark.parametrize("high", [1, 2, 300, 50257, 1 << 31, 1 << 59])
def test_simple8b(high):
    for n in (0, 1, 59, 511, 512, 513, 3000):
        ids = np.random.default_rng(n).integers(0, high, n).astype(np.uint64)
        assert (token_file.unpack(*token_file.pack(ids), n) == ids).all()


def test_substring_dedup(docs, empty, rows):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            first[k] = min(first.get(k, i), i)
    want = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = {j for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for j in range(p, p + 50)}
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    got = substring_dedup.remove_duplicates(docs).collect()
    assert len(got) == len(rows) and all((r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)
    assert substring_dedup.remove_duplicates(empty).count() == 0


def test_jaccard_join(docs, empty, rows):
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set()) for i, t, *_ in rows]
    links, label = [0] * len(sets), list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and len(x & y) / len(x | y) >= 0.8:
            links[a] += 1
            links[b] += 1
            label = [min(label[a], label[b]) if v in (label[a], label[b]) else v for v in label]
    want = sorted((sets[k][0], sets[label[k]][0], links[k]) for k in range(len(sets)))
    assert sorted(map(tuple, jaccard_join.join_similar(docs).collect())) == want
    # the same with tiny buckets and blocks: splits and block pairs
    assert sorted(map(tuple, jaccard_join.join_similar(docs, limit=2, block=1).collect())) == want
    assert jaccard_join.join_similar(empty).count() == 0


def test_fingerprint(docs, empty, rows):
    got = {(r["doc_id"], r["edited_sha256"]): r for r in fingerprint.fingerprint_documents(docs).collect()}
    ordered = sorted(rows, key=lambda r: r[0])
    for k, (i, t, *_) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        q = len(t) // 4
        r = got[i, hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()]
        assert r["n_chars"] == len(t) and 0 <= r["near_edited"] <= 1
    same = {r["fingerprint"] for r in got.values() if r["doc_id"] in (0, 1)}
    assert len(same) == 1
    assert fingerprint.fingerprint_documents(empty).count() == 0


def mixed(df):
    """op10's result of a small table, without its files."""
    keyed = df.select("doc_id", F.col("source"), mixture.word_count(F.col("text")).alias("size"), *mixture._content(df.select("doc_id", "source", "text")))
    rows = written(mixture.numbered_rows(keyed), "test")
    return rows, *mixture.mix(rows, block_words=16, shard_slots=8, chunk_rows=3)


def test_mixture(docs, empty, rows):
    sized, sources, pieces = mixed(docs)
    facts = {r["source"]: r for r in sources.collect()}
    size = {(r["r1"], r["r2"]): (r["size"], r["source"]) for r in sized.collect()}
    assert len(size) == len(rows)  # the repeated row is a row of its own
    got = pieces.collect()
    taken = Counter()
    for r in got:
        n, _ = size[r["r1"], r["r2"]]
        assert 0 <= r["from"] < r["to"] <= n
        taken[r["r1"], r["r2"]] += r["to"] - r["from"]
    assert all(n <= 3 * size[k][0] for k, n in taken.items())
    for s, f in facts.items():
        assert abs(sum(n for k, n in taken.items() if size[k][1] == s) - f["target"]) <= 1
        assert f["source_size"] == sum(n for n, t in size.values() if t == s)
    # a pass takes no word twice
    seen = Counter((r["r1"], r["r2"], r["epoch"], w) for r in got for w in range(r["from"], r["to"]))
    assert max(seen.values()) == 1
    # slots are numbered through, in the order of their shards; blocks of a slot lie together
    for s in range(len(facts)):
        of = {r["slot"]: r["shard"] for r in got if facts[size[r["r1"], r["r2"]][1]]["source_no"] == s}
        assert sorted(of) == list(range(len(of))) and [of[k] for k in sorted(of)] == sorted(of.values())
    assert len({r["shard"] for r in got}) > 3
    assert mixture.targets({"a": 10, "b": 1000, None: 10}, (5, 2, 1), 3)["a"] == 30
    assert sum(mixture.targets({"a": 10, "b": 1000, "c": 3, None: 10}, (5, 2, 1), 3).values()) == pytest.approx(1023)


def test_mixture_does_not_depend_on_the_layout(spark, rows):
    results = []
    for parts in (1, 4, 7):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts, "text")
        results.append(sorted(map(tuple, mixed(df)[2].collect())))
    assert results[0] == results[1] == results[2]


def test_mixed_documents(spark, docs, empty, rows):
    _, _, pieces = mixed(docs)
    del pieces
    out = mixture.mixed_documents(docs)
    assert out.columns == docs.columns and mixture.mixed_documents(empty).count() == 0
    got = out.collect()
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(words(t))
    for r in got:
        w = words(r["text"])
        assert w and any(_subsequence(w, t) for t in texts[r["doc_id"]])
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(words(t))
    aims = mixture.targets(dict(sizes), (5, 2, 1), 3)
    for s, n in aims.items():
        assert abs(sum(len(words(r["text"])) for r in got if r["source"] == s) - n) <= 1
    assert "mix_shard" in mixture.mixed_documents(docs, with_shard=True).columns


def _subsequence(part, whole):
    it = iter(whole)
    return all(w in it for w in part)


def test_permutation_is_a_bijection(spark):
    df = spark.range(0, 1000).select(mixture.permuted(F.col("id"), F.lit(1000).cast("long"), F.lit(3), F.lit(1), 20).alias("p"))
    got = [r["p"] for r in df.collect()]
    assert sorted(got) == list(range(1000)) and got != sorted(got)


def test_repeated_rows_are_numbered(spark):
    df = spark.createDataFrame([(1, "a b", "s")] * 5 + [(2, "a b", "s"), (None, None, None), (None, None, None)], SCHEMA.split(", lang")[0] + ", source string")
    keyed = df.select("source", mixture.word_count(F.col("text")).alias("size"), *mixture._content(df))
    got = mixture.numbered_rows(keyed).collect()
    assert sorted(r["copy"] for r in got) == [0, 0, 0, 1, 1, 2, 3, 4] and len({(r["r1"], r["r2"]) for r in got}) == 8


def test_personal_data(docs, empty):
    t = "mail a.b@c.de, 1.2.3.4 and 1.2.3.999, card 4111 1111 1111 1111, +1 (988) 555-2485"
    kinds = [personal_data.KINDS[k] for _, k, _ in personal_data.base_spans(t)]
    assert kinds == ["email", "ip", "card", "phone"]
    assert personal_data.base_spans("a@b@c.d") == [(2, 0, 7)] and personal_data.base_spans("9" * 100_000) == []
    got = personal_data.find_personal_data(docs).collect()
    assert len(got) == docs.count() and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    assert personal_data.find_personal_data(empty).count() == 0


def test_context_finds_unseen_identifiers(spark):
    rows = [(i, f"please call number +1 (98{i}) 555-24{i}5 today") for i in range(9)] + [(99, "please call number 5550199-77 today")]
    got = {r["doc_id"]: r for r in personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99]["spans"] == "context:19:29" and got[0]["n_context"] == 0


def test_language_id(spark, empty):
    rows = [(i, ("the house and the garden" if i % 2 else "das haus und der garten") + f" {i}", "en" if i % 2 else "de") for i in range(60)] + [(60, None, "en"), (61, "123", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df, language_id.train(df, F.lit(True))).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(60))
    assert got[60]["lang_pred"] == got[61]["lang_pred"] == "und" and got[60]["score"] == 0
    assert language_id.train(empty, F.lit(True)).languages == []


def plain_matches(texts, items, window=5, share=0.8, least=13):
    """(text number, item number) by brute force over all alignments; texts and items are (kinds, values)."""
    out = set()
    for a, (c, v) in enumerate(texts):
        for b, (ic, iv) in enumerate(items):
            total = max(1, len(ic) - window + 1) if ic else 0
            for shift in range(-len(ic), len(c) + 1):
                if len(ic) < window or len(c) < window:
                    places = [0] if ic and shift == 0 and ic == c else []
                else:
                    places = [p for p in range(total) if 0 <= p + shift <= len(c) - window and ic[p : p + window] == c[p + shift : p + shift + window]]
                slots = {p + k for p in places for k in range(min(window, len(ic)))}
                pairs = {(ic[k], iv[k], v[k + shift]) for k in slots if ic[k] != iv[k]}
                if len({x[:2] for x in pairs}) < len(pairs) or len({(x[0], x[2]) for x in pairs}) < len(pairs):
                    continue
                best = run = 0
                for k, p in enumerate(places):
                    run = run + 1 if k and places[k - 1] == p - 1 else 1
                    best = max(best, run)
                if places and (len(places) >= share * total or best >= least - window + 1):
                    out.add((a, b))
    return out


def test_decontaminate(spark, empty):
    bench = spark.createDataFrame([(1, "In the morning Alice buys 3 apples and 4 pears for 7 dollars at the old market by the river")], "item_id long, text string")
    again = "some words before. In the morning Bob buys 5 apples and 6 pears for 11 dollars at the old market by the river and more"
    clash = again.replace("6 pears", "5 pears")
    df = spark.createDataFrame([(1, again), (2, clash), (3, "nothing of the kind stands here at all, not even 3 apples"), (4, None), (None, bench.first()["text"]), (None, "clean")], "doc_id long, text string")
    got = {(r["doc_id"], r["contaminated"]) for r in decontaminate.report(df, bench).collect()}
    assert got == {(1, True), (2, False), (3, False), (4, False), (None, True), (None, False)}
    kept = decontaminate.without_contaminated(df.withColumn("h1", F.lit("x")), bench)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "clean"), (2, clash), (3, df.collect()[2]["text"]), (4, "")] and kept.columns == ["doc_id", "text", "h1"]
    assert decontaminate.report(empty.select("doc_id", "text"), bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in decontaminate.report(df, none).collect()} == {False}
    assert decontaminate.contaminated(df, bench).select("doc_id", "item_id").distinct().count() == 2


def test_decontaminate_against_brute_force(spark):
    rng = np.random.default_rng(12)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Alice", "Bob", "3", "4 km", "5", "of", "the", "is"]
    draw = lambda n: [str(x) for x in rng.choice(vocabulary, n)]
    items = [" ".join(draw(n)) for n in (3, 5, 6, 8, 14, 20, 30, 60)] * 2 + [None, ""]
    texts = []
    for _ in range(60):
        w = (items[rng.integers(0, 8)] or "").split()
        for _ in range(rng.integers(0, 4)):  # changed, lost and new words
            at = int(rng.integers(0, len(w)))
            w[at : at + int(rng.integers(0, 2))] = draw(int(rng.integers(0, 2)))
        texts.append(" ".join(draw(int(rng.integers(0, 12))) + w + draw(int(rng.integers(0, 12)))))
    # ten pieces of five words at different shifts are no passage
    long = items[7].split()
    texts += [" ".join(" ".join(long[k : k + 5]) + " zeta" * (k % 7 + 1) for k in range(0, 50, 5)), items[0], items[3], None, "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    cut = lambda frame, key: [(r["c"], r["v"]) for r in frame.select(key, decontaminate._tokens(F.coalesce("text", F.lit(""))).alias("v")).withColumn("c", decontaminate._kinds(F.col("v"))).orderBy(key).collect()]
    want = plain_matches(cut(df, "doc_id"), cut(bench, "item_id"))
    assert len(want) > 20
    for few in (200_000, 0):  # broadcast and shuffled
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench, most_broadcast=few).collect()} == want


def test_toxicity_marginals():
    rng = np.random.default_rng(4)
    e, t = rng.normal(size=7), np.log(np.array([[0.9, 0.1], [0.4, 0.6]]))
    total, hit = 0.0, np.zeros(7)
    for code in range(1 << 7):
        y = [(code >> k) & 1 for k in range(7)]
        p = np.exp(sum(e[k] * y[k] for k in range(7)) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        hit += p * np.array(y)
    assert toxicity.marginals(e, np.array([7]), t) == pytest.approx(hit / total)
    long = rng.normal(size=10_000)
    assert toxicity.marginals(long, np.array([10_000]), t)[:4000] == pytest.approx(toxicity.marginals(long[:4090], np.array([4090]), t)[:4000], abs=1e-9)


def test_toxicity(spark):
    sample = [("you are an idiot and a moron" + " word" * (k % 7), 1) for k in range(40)] + [("you are an honest and a friendly one on a calm day" + " word" * (k % 9), 0) for k in range(60)]
    model = toxicity.fit(sample)
    df = spark.createDataFrame([(1, "you are an idiot"), (2, "a calm day"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.tag_toxic(df, model).collect()}
    assert got[1]["score"] > 0.5 > got[2]["score"] and got[3]["score"] == got[4]["score"]
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [(11, 16)]


def test_toxicity_learns_behind_long_beginnings(spark):
    calm = " ".join(f"w{k % 97}" for k in range(1100))
    sample = [(f"{calm} you are an idiot today", 1) for _ in range(20)] + [(f"{calm} you are an honest one today", 0) for _ in range(20)]
    model = toxicity.fit(sample)
    df = spark.createDataFrame([(1, f"{calm} you are an idiot today"), (2, f"{calm} you are an honest one today")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in toxicity.tag_toxic(df, model).collect()}
    at = len(calm) + len(" you are an ")
    assert got == {1: [(at, at + 5)], 2: []}


def test_keep_one_of_each(spark, empty):
    rng = np.random.default_rng(8)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    near = a.split()
    near[30] = "changed"
    rows = [(1, a), (1, a), (1, a), (2, " ".join(near)), (2, b), (None, c), (None, c), (4, d), (None, d), (3, b), (5, e), (6, None), (6, None), (7, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place long").repartition(3)
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in jaccard_join.keep_one_of_each(df).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (0, c), (4, d), (5, e), (6, None), (6, None), (7, "")], key=str)
    assert jaccard_join.keep_one_of_each(df).columns == df.columns
    assert jaccard_join.keep_one_of_each(empty).count() == 0


def test_decontaminate_names_are_whole_words(spark):
    bench = spark.createDataFrame([(1, "when the PhD student Alice met McDonald near GitHub then Alice gave 3 apples and 3 pears at 5 % to Alice by the river")], "item_id long, text string")
    passage = "when the PhD student Bob met McDonald near GitHub then Bob gave 4 apples and 4 pears at 6 % to Bob by the river"
    rows = [(1, bench.first()["text"]), (2, "so the PhD from McDonald wrote on GitHub. " + passage), (3, passage.replace("4 pears", "9 pears")), (4, "no such passage by the PhD on GitHub")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["contaminated"] for r in decontaminate.report(df, bench).collect()} == {1: True, 2: True, 3: False, 4: False}
    texts = [t for _, t in rows] + ["5km, 3,000.5 kg 40% of İstanbul, José Ångström \ue002x 7\ue0018 PhDs", ""]
    cut = spark.createDataFrame([(t,) for t in texts], "text string").select(decontaminate._tokens(F.col("text")).alias("v")).withColumn("c", decontaminate._kinds(F.col("v"))).collect()
    marks = (decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME)
    assert all(c == (v[0] if v[0] in marks else v) for r in cut for c, v in zip(r["c"], r["v"], strict=True))
    assert [v[1:] for v in cut[1]["v"] if v[0] in marks] == ["bob", "bob", "4", "4", "6", "%", "bob"]


def test_components_settle_or_raise(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {tuple(r) for r in connected_components(path).collect()} == {(k, 0) for k in range(41)}
    with pytest.raises(RuntimeError):
        connected_components(path, max_rounds=2)


def test_encoder_equals_the_library():
    encoder = token_file.Encoder(token_count.tokenizer_path("byte_bpe_50k.json"))
    held, (token_file._Known.LIMIT, token_file._Known.WAITING) = (token_file._Known.LIMIT, token_file._Known.WAITING), (20, 30)  # both turn over
    rng = np.random.default_rng(9)
    parts = ["a", "I'll", "don't", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "😀", "<|endoftext|>", "12", "3.5", ",", ".", "word", "Σας", "İ", "\0", "\x1c", "\xa0", "　", "x" * 30, "'s", "ﬁ", "é", "\r\n", " ,", "_", "\x85", "word,", "word."]
    texts = ["".join(rng.choice(parts) + (" " if rng.random() < 0.4 else "") for _ in range(rng.integers(0, 14))) for _ in range(3000)]
    flat, sizes = encoder.encode(texts, 0)
    token_file._Known.LIMIT, token_file._Known.WAITING = held
    ends = np.cumsum(sizes)
    for t, e, n in zip(texts, ends, sizes, strict=True):
        assert flat[e - n : e].tolist() == encoder.library.encode(t, add_special_tokens=False).ids + [0], repr(t)


def plain_base(text):
    """The base rules as they are written: leftmost matches that don't overlap, failing ones dropped without a retry."""
    def luhn(m):
        d = [int(c) for c in m if c.isdigit()]
        twice = [x * 2 - 9 * (x > 4) for x in d[-2::-2]]
        return 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(twice)) % 10 == 0

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", luhn),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c in "0123456789" for c in m) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (rule, holds) in enumerate(rules) for m in re.finditer(rule, text) if holds(m.group()))


def test_base_spans_against_the_rules():
    rng = np.random.default_rng(21)
    parts = ["a", "b.c", "@", ".", "-", "+", "1", "12", "255", "256", "0", " ", "(", ")", "4111 1111 1111 1111", "4111111111111111", "@x.de", "a@b.c", "1.2.3.4", "+1 (988) 555-2485", "é", "_", "%", "٣", "\n"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert personal_data.base_spans(t) == plain_base(t), repr(t)


def test_candidates_are_linear_and_whole():
    text = "漢" * 300_000 + "7" + "字" * 300_000 + " x1 'y2'=z3 q"
    assert list(personal_data.candidates(text)) == [(0, 600_001), (600_002, 600_004), (600_006, 600_008), (600_010, 600_012)]
    assert len(list(personal_data.candidates("a1" * 200_000))) == 1


def test_keys_are_found_by_their_context(spark):
    rng = np.random.default_rng(2)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    rows = [(i, f"some words then token = \"{key()}\" and more words", None) for i in range(40)]
    rows += [(50, 'here token = "short7key" stands', None), (51, f"a single {key()} among words", None), (52, "version 3.14159 of it", None), (53, None, None)] + [rows[0]] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {}
    for r in personal_data.find_personal_data(df).collect():
        got.setdefault(r["doc_id"], []).append((r["n_context"], r["n_spans"]))
    assert all(x == (1, 1) for i in range(40) for x in got[i]) and len(got[0]) == 3
    assert got[50] == [(1, 1)] and got[51] == got[52] == got[53] == [(0, 0)]


def test_pattern_scores_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    edges = {(int(p), int(i)): bool(i % 3 == 0) for p, i in rng.integers(0, [12, 60], (300, 2))}
    belief = {i: float(i % 3 == 0) for _, i in edges}
    for turn in range(3):
        found = {}
        for p in {p for p, _ in edges}:
            mine = [belief[i] for q, i in edges if q == p]
            found[p] = sum(mine) / (len(mine) + 1)
        if turn < 2:
            belief = {i: max(float(i % 3 == 0), max(found[p] for p, j in edges if j == i)) for i in belief}
    df = written(spark.createDataFrame([(p, i, s, 1) for (p, i), s in edges.items()], "pattern long, instance long, seed boolean, times long"), "test")
    got = {r["pattern"]: r["confidence"] for r in personal_data.pattern_scores(df).collect()}
    assert got == pytest.approx(found)


def plain_bayes(sample, texts, orders=(2, 3), buckets=1 << 16, smoothing=0.5):
    """Naive Bayes over the same buckets, n-gram by n-gram."""
    def grams(t):
        f = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else 0 for c in f" {t}  "]
        for n in orders:
            for k in range(len(f) - n + 1):
                g = f[k : k + n]
                if not any(a == b == 0 for a, b in zip(g, g[1:], strict=False)):
                    yield int(language_id.bucketed(np.array(g, dtype=np.uint32), n, buckets)[0])

    languages = sorted({lang for _, lang in sample})
    counts = {lang: Counter(g for t, x in sample if x == lang for g in grams(t)) for lang in languages}
    total = {lang: sum(c.values()) + smoothing * buckets for lang, c in counts.items()}
    out = []
    for t in texts:
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
            continue
        score = {lang: np.log(sum(x == lang for _, x in sample) / len(sample)) + sum(np.log((counts[lang][g] + smoothing) / total[lang]) for g in grams(t)) for lang in languages}
        best = max(languages, key=lambda x: score[x])
        out.append((best, 1 / sum(np.exp(v - score[best]) for v in score.values())))
    return out


def test_language_id_against_a_plain_version(spark):
    rng = np.random.default_rng(31)
    word = {"en": "the house and garden of a king".split(), "de": "das haus und der garten ein König".split(), "fr": "la maison et le jardin été".split()}
    draw = lambda k, n: " ".join(rng.choice(word[k], n))
    sample = [(draw(k, 6), k) for k in ("en", "de", "fr") for _ in range(12)]
    texts = [draw(k, n) for k in word for n in (1, 2, 5)] + ["", None, "123 -- 4", "x", "KÖNIG İst", "the haus", "a\n\nthe  garden"]
    rows = [(i, t, k) for i, (t, k) in enumerate(sample)] + [(100 + i, t, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, lang string")
    model = language_id.train(df, F.lit(True))
    got = [(r["lang_pred"], r["score"]) for r in language_id.identify(df.where("doc_id >= 100"), model).orderBy("doc_id").collect()]
    want = plain_bayes(sample, [*texts, texts[-1]])
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-8)


def test_language_id_of_long_texts(monkeypatch):
    rng = np.random.default_rng(32)
    model = language_id.LanguageModel(["a", "b"], np.log([0.5, 0.5]), np.append(np.log(rng.dirichlet(np.ones(5000), 2)), np.zeros((2, 1)), axis=1))
    texts = ["".join(rng.choice(list("abc  1é"), n)) for n in (0, 3, 199, 200, 201, 5000)]
    want = language_id.predict(model, texts)
    monkeypatch.setattr(language_id, "_PIECE", 200)
    got = language_id.predict(model, texts)
    assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-9)


def test_language_id_ties_and_many_languages(spark):
    rows = [(i, "same words", lang) for i, lang in enumerate(["b", "a", "b", "a"])] + [(9, "same words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, F.lit(True), most_cells=2000)
    assert model.log_prob.shape == (2, 1001)
    assert {r["lang_pred"] for r in language_id.identify(df, model).collect()} == {"a"}


def test_toxicity_pairs_against_enumeration():
    rng = np.random.default_rng(6)
    e, t = rng.normal(size=11), rng.normal(size=(2, 2))
    sizes, want = np.array([6, 0, 5]), np.zeros((2, 2))
    for at, n in ((0, 6), (6, 5)):
        total, mine = 0.0, np.zeros((2, 2))
        for code in range(1 << n):
            y = [(code >> k) & 1 for k in range(n)]
            p = np.exp(sum(e[at + k] * y[k] for k in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += p
            for a, b in zip(y, y[1:], strict=False):
                mine[a, b] += p
        want += mine / total
    pairs = np.zeros((2, 2))
    toxicity.marginals(e, sizes, t, pairs)
    assert pairs == pytest.approx(want)
    # the same in lanes shorter than the text
    long, whole, cut = rng.normal(size=600), np.zeros((2, 2)), np.zeros((2, 2))
    toxicity.marginals(long, np.array([600]), t, whole)
    lane, toxicity.LANE = toxicity.LANE, 100
    toxicity.marginals(long, np.array([600]), t, cut)
    toxicity.LANE = lane
    assert cut == pytest.approx(whole, abs=1e-6) and whole.sum() == pytest.approx(599)


def test_toxicity_of_odd_tables(spark):
    schema = "doc_id long, text string, score string"
    docs = spark.createDataFrame([(1, "İİ you idiot", None), (2, None, "x"), (2, None, "x"), (None, "a calm day", None)], schema)
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int, quality int")
    assert toxicity.labelled_sample(docs, labels([])) == ([], 0.0)
    sample, share = toxicity.labelled_sample(docs, labels([(2, 1, 0), (2, 1, 1), (None, 1, 0), (1, None, 0)]))
    assert sample in ([("", 1)], []) and share in (1.0, 0.0)
    for rows, want in (([], 0.0), ([("x", 1)], 1.0), ([("x", 0)], 0.0)):
        got = toxicity.tag_toxic(docs, toxicity.fit(rows)).collect()
        assert len(got) == 4 and all(abs(r["score"] - want) < 1e-6 for r in got)
    assert toxicity.tag_toxic(docs.limit(0), toxicity.fit([])).count() == 0
    model = toxicity.fit([("you idiot", 1)] * 30 + [("you calm one", 0)] * 30)
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in toxicity.tag_toxic(docs, model).collect()}
    assert spans[1] == [(7, 12)]


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(7)
    calm = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(rng.choice(calm, rng.integers(5, 60))) + (" you utter idiot" if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    tagged = toxicity.tag_toxic(docs, toxicity.fit(*toxicity.labelled_sample(docs, labels))).withColumn("held", toxicity.fold() == 2).collect()
    held = [r for r in tagged if r["held"]]
    assert len(held) > 60 and sum((r["score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in held) / len(held) > 0.97


def test_fingerprints_agree_as_often_as_jaccard(spark):
    rng = np.random.default_rng(41)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary, 80, p=rng.dirichlet(np.ones(60) * 0.3)))) for i in range(40)]
    rows += [(100 + i, t) for i, t in rows[:20]] + [(200, None), (201, ""), (None, "w1 w2"), (5, "another text of an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.fingerprint_documents(df, samples=128).collect()
    assert len(got) == len(rows)
    weights = lambda t: {w: 1 + np.log(n) for w, n in Counter((t or "").split()).items()}

    def likeness(a, b):
        x, y = weights(a), weights(b)
        keys = x.keys() | y.keys()
        return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys) if keys else 1.0

    once = {i: t for i, t in rows if i is not None and i != 5}
    order = sorted(once)
    errors = []
    for k, i in enumerate(order[6:-3], 6):
        nxt, t = once[order[k + 1]], once[i]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = next(r for r in got if r["doc_id"] == i)
        errors += [r["near_next"] - likeness(t, nxt), r["near_edited"] - likeness(t, edited)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06

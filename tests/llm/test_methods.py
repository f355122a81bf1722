"""Each operator against a plain brute-force version, on small tables with copies and near copies."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_sharding_is_minimax(spark):
    from tessera.llm.sharding import partition

    rng = random.Random(3)
    for shards, n in ((3, 9), (4, 12), (2, 5), (5, 3)):
        sizes = [rng.randint(1, 30) for _ in range(n)]
        atoms = spark.createDataFrame([(i, False, 0, s) for i, s in enumerate(sizes)], "block int, heavy boolean, hash long, size long")
        got = partition(atoms, shards).collect()
        order = [r["size"] for r in sorted(got, key=lambda r: (-r["size"] if r["size"] * shards > sum(sizes) else 0, r["block"]))]
        best = min(
            max(sum(order[a:z]) for a, z in zip((0, *cut), (*cut, n), strict=True))
            for cut in combinations_with_replacement(range(n + 1), shards - 1)
        )
        loads = defaultdict(int)
        for r in got:
            loads[r["shard"]] += r["size"]
        assert {r["capacity"] for r in got} == {best} and max(loads.values()) <= best and max(loads) < shards


def test_shards_of_documents(spark, docs):
    from tessera.llm.sharding import shard

    hot = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, "one hot text " * 30).otherwise(F.col("text")))
    for table in (docs, hot):
        text = {r["doc_id"]: r["text"] for r in table.collect()}
        got = shard(table).collect()
        where, slots, loads = {}, defaultdict(list), defaultdict(int)
        for r in got:
            t = text[r["doc_id"]]
            assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode()) and 0 <= r["shard"] < 40
            assert where.setdefault(t, r["shard"]) == r["shard"]
            slots[r["shard"]].append(r["slot"])
            loads[r["shard"]] += r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(loads.values()) / 40
    assert sum(load > 3 * mean for load in loads.values()) <= 1


def test_buckets_are_optimal(spark):
    from tessera.llm.packing import boundaries, cell, pack

    rng = random.Random(1)
    for _ in range(30):
        tops = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        rows = [rng.randint(1, 5) for _ in tops]
        k = rng.randint(1, 4)
        got = boundaries(tops, rows, [t * r for t, r in zip(tops, rows, strict=True)], k)

        def cost(ends):
            return sum((next(e for e in ends if e >= t) - t) * r for t, r in zip(tops, rows, strict=True))

        best = min(cost(sorted({*c, tops[-1]})) for c in combinations_with_replacement(tops, k - 1))
        assert cost(got) == best and len(got) <= k
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"))
    out = pack(d, buckets=5, tokens=300).collect()
    batches = defaultdict(list)
    for r in out:
        assert r["n_tokens"] <= r["padded"]
        batches[r["bucket"], r["batch"]].append(r)
    for b in batches.values():
        assert len(b) * b[0]["padded"] <= 300 and sorted(r["slot"] for r in b) == list(range(len(b))) and {r["batch_rows"] for r in b} == {len(b)}
    lengths = spark.createDataFrame([(10**k,) for k in range(12)], "length long")
    assert lengths.select(cell(F.col("length")).alias("c")).agg(F.max("c")).first()[0] < 4096 + 64 * 256


def plain_components(n, near):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if near(i, j) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_simhash_components(docs, texts):
    from tessera.llm.simhash import near_duplicates

    def fingerprint(t):
        w = t.encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    ids = sorted(texts)
    want = [fingerprint(texts[i]) for i in ids]
    got = {r["doc_id"]: (r["f0"] % 2**64, r["component_id"]) for r in near_duplicates(docs).collect()}
    label = plain_components(len(ids), lambda i, j: (want[i] ^ want[j]).bit_count() <= 4)
    assert got == {d: (f, ids[lb]) for d, f, lb in zip(ids, want, label, strict=True)}


@pytest.mark.parametrize("limit", [16_384, 7])
def test_links_with_sliced_buckets(spark, monkeypatch, limit):
    import tessera.llm.simhash as S
    from tessera.llm.components import components

    monkeypatch.setattr(S, "SLICE", limit)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6)
    bits = {int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 7), replace=False))) for b in np.repeat(base, 20)}
    nodes = spark.createDataFrame([(b, b) for b in bits], "node long, f0 long")
    stars = {r["u"]: r["v"] for r in components(S.links(nodes, S.lossless_masks(len(bits)), 4)).collect()}
    order = sorted(bits)
    label = plain_components(len(order), lambda i, j: (order[i] ^ order[j]).bit_count() <= 4)
    assert {b: stars.get(b, b) for b in order} == {b: order[lb] for b, lb in zip(order, label, strict=True)}


def test_masks_keep_near_pairs_together():
    from tessera.llm.simhash import lossless_masks

    rng = random.Random(2)
    for count in (10, 10**8, 10**10):
        masks = [m[0] for m in lossless_masks(count)]
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << k for k in rng.sample(range(64), 4))
            assert any(a & m == b & m for m in masks)


def test_near_copies_go_and_clean_documents_stay(spark):
    from tessera.llm.simhash import representatives

    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    clean = [[rng.choice(vocab) for _ in range(300)] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(clean)]
    for i, w in enumerate(clean[:20]):
        near = list(w)
        for k in rng.sample(range(300), 4):  # about 0.88 of five-word shingles stay
            near[k] = rng.choice(vocab)
        rows.append((1000 + i, " ".join(near)))
    left = {r["doc_id"] for r in representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(60)) <= left and len(left - set(range(60))) <= 1


@pytest.mark.parametrize("count", [1_000, 90_000, 5_600_000])
def test_sampled_masks_find_pairs_at_the_radius(count):
    from tessera.llm.simhash import sampled_masks

    rng = np.random.default_rng(11)
    keys = [sum(m << (64 * k) for k, m in enumerate(mask)) for mask in sampled_masks(count, 4, 52)]
    differ = [sum(1 << int(b) for b in rng.choice(256, 52, replace=False)) for _ in range(1000)]
    assert sum(any(not d & key for key in keys) for d in differ) >= 975


@pytest.mark.parametrize("others", [100, 2_000])
def test_near_copies_at_the_threshold_are_found(spark, others):
    from tessera.llm.simhash import representatives

    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    clean = [[rng.choice(vocab) for _ in range(304)] for _ in range(others)]
    rows = [(i, " ".join(w)) for i, w in enumerate(clean)]
    for i, w in enumerate(clean[:100]):
        near = list(w)
        near[40:70] = [rng.choice(vocab) for _ in range(30)]  # 266 of 300 shingles stay: a similarity of 0.8 of all in either
        rows.append((10_000 + i, " ".join(near)))
    left = {r["doc_id"] for r in representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(others)) <= left and len(left) - others <= 3


def test_line_dedup(spark):
    from tessera.llm.line_dedup import drop_lines, line_dedup, within_one

    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    lines = [[rng.choice(words) for _ in range(rng.randint(1, 9))] for _ in range(120)]
    for _ in range(120):
        w = list(rng.choice(lines))
        k = rng.randrange(len(w) + 1)
        w[k : k + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
        lines.append(w)
    rng.shuffle(lines)
    docs = [(d, "\n".join(" ".join(w) for w in lines[d * 6 : d * 6 + 6])) for d in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["dropped"] for r in line_dedup(df).collect()}
    before, want = [], {}
    for d, text in docs:
        want[d] = []
        for at, line in enumerate(text.split("\n")):
            w = line.encode().split()
            if w and any(w == x or (min(len(w), len(x)) >= 5 and within_one(w, x)) for x in before):
                want[d].append(at)
            before += [w] * bool(w)
    assert got == want and any(want.values())
    kept = {r["doc_id"]: r["text"] for r in drop_lines(df, line_dedup(df)).collect()}
    assert kept[0] == "\n".join(x for k, x in enumerate(docs[0][1].split("\n")) if k not in want[0])


def test_variants_are_hashes_of_the_shortened_lines():
    from tessera.llm.line_dedup import variants

    words = [b"w%d" % (k * k % 7) for k in range(30)]
    found = variants(words).tolist()
    assert found == [variants(words[:k] + words[k + 1 :])[-1] for k in range(30)] + [variants(words)[-1]]
    assert variants(words[::-1])[-1] != found[-1] and len(variants([b"one"])) == 2


def test_very_long_lines(spark):
    from tessera.llm.line_dedup import line_dedup

    words = [f"w{k % 997}" for k in range(200_000)]
    docs = [" ".join(words), " ".join(words[:7] + words[8:]), " ".join([*words[:9], "x", *words[10:]]), " ".join(words[::-1])]
    got = line_dedup(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {0: 0, 1: 1, 2: 1, 3: 0}


@pytest.mark.parametrize("a, b, near", [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b c", "a c", True), ("a b c", "x a b c", True), ("a b c", "b a c", False), ("a", "", True), ("a b", "", False), ("a b c", "a x c d", False)])
def test_within_one(a, b, near):
    from tessera.llm.line_dedup import within_one

    assert within_one(a.split(), b.split()) == within_one(b.split(), a.split()) == near


def test_language_accuracy(spark):
    from tessera.llm.langid import fit, held_out, identify

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(d, fit(d)).filter(held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.98


def test_filters_answer_for_all_languages():
    from tessera.llm.langid import Filters

    rng = np.random.default_rng(0)
    members = {f"l{k:02d}": rng.integers(0, 2**63, 500).astype(np.uint64) for k in range(70)}  # more than one lane
    f = Filters.build(members)
    bits = int(np.log2(len(f.slices)))
    for k, lang in enumerate(f.langs):
        mask = None
        for p in f.positions(members[lang], bits):
            mask = f.slices[p] if mask is None else mask & f.slices[p]
        counts = f.popcounts(mask)
        assert counts[k] == 500 and np.median(counts) < 30
    assert (f.false_rate < 0.05).all()


def test_decisions_against_plain_sets(spark):
    from collections import Counter

    from tessera.llm.langid import Filters, fit, grams, held_out, letters

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = [(r["lang"], r["text"]) for r in d.filter(~held_out(F.col("doc_id"))).collect()]
    spelled = lambda t: [p[i : i + n] for p in [letters(t)] for n in (3, 4) for i in range(len(p) - n + 1)]
    hashed = lambda g: int(next(grams(g, (len(g),)))[0])
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in learned:
        counts[lang].update(spelled(text))
    top = 300
    found = fit(d, top=top)
    bits = int(np.log2(len(found.slices)))
    sets = {}
    for k, lang in enumerate(found.langs):
        order = counts[lang].most_common(top + 1)
        sure = [g for g, n in order if n > order[top][1]]  # ties at the last place may go either way
        h = np.array([hashed(g) for g in sure], dtype=np.uint64)
        assert all(((found.slices[p, k // 64] >> np.uint64(k % 64)) & np.uint64(1) == 1).all() for p in found.positions(h, bits))
        sets[lang] = set(sure)
    plain = Filters.build({lang: np.array([hashed(g) for g in s], dtype=np.uint64) for lang, s in sets.items()})
    for _, text in learned[::7]:
        all_grams = spelled(text)
        share = {lang: sum(g in s for g in all_grams) / max(len(all_grams), 1) for lang, s in sets.items()}
        lang, score = plain.decide(text)
        if not all_grams:
            assert (lang, score) == ("und", 0.0)
            continue
        assert share[lang] >= max(share.values()) - 0.02 and score == pytest.approx(share[lang], abs=0.03)


def test_search_recall(spark):
    from tessera.llm.ann import search

    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = v.orderBy("vec_id").toPandas()
    m, ids = np.array(x["embedding"].tolist(), dtype=np.float64), x["vec_id"].to_numpy()
    hits = total = 0
    for q, got in search(v, F.col("vec_id") % 100 == 0).toPandas().groupby("query_id"):
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hits += len(set(best) & set(got["vec_id"]))
        total += 10
        assert np.allclose(got.sort_values("rank")["score"], np.sort(d[np.isin(ids, got["vec_id"])]))
    assert hits / total >= 0.9


def test_search_is_exact_on_vectors_that_codes_confuse(spark):
    from tessera.llm.ann import search

    rng = np.random.default_rng(5)
    groups = rng.normal(size=(4, 16))[rng.integers(0, 4, 2000)] + 1e-4 * rng.normal(size=(2000, 16))
    scales = rng.normal(size=(1000, 16)) * np.exp(3 * rng.normal(size=(1000, 1)))
    far = rng.normal(size=(100, 16)) * 1e20
    m = np.concatenate([groups, scales, far, rng.integers(0, 2, (400, 16)) + 1e4]).astype(np.float32).astype(np.float64)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<float>")
    got = {q: g.sort_values("rank") for q, g in search(v, F.col("vec_id") % 25 == 0).toPandas().groupby("query_id")}
    assert len(got) == 140
    for q, found in got.items():
        d = np.zeros(len(m))
        for column in m.T:
            d += (column - column[q]) * (column - column[q])
        d = np.sqrt(d)
        d[q] = np.inf
        best = np.lexsort((np.arange(len(m)), d))[:10]
        assert list(found["vec_id"]) == list(best) and list(found["score"]) == list(d[best])


def test_bigram_models(spark, docs):
    from tessera.llm.lm_scoring import WEIGHT, add_up, counts, fit, score

    target = docs.filter("lang = 'de'")
    scorer = fit(docs, target)
    words = {r["w"]: r for r in scorer.words.collect()}
    found = counts(docs.select("text", F.lit(False).alias("target"), F.lit(True).alias("background")), 5)
    pairs = {(r["v"], r["w"]): r["b"] for r in add_up(found, 1).filter("v IS NOT NULL").collect()}
    single = {w: (r["b"] + 1) / (scorer.total["b"] + scorer.size) for w, r in words.items()}
    follow = defaultdict(dict)
    for (v, w), n in pairs.items():
        if n >= 2:
            follow[v][w] = n
    for v in list(follow)[::50]:  # a context's probabilities sum to 1, the unknown word's among them
        left = 1 - WEIGHT * words[v]["kb"] / words[v]["b"]
        assert words[v]["kb"] == sum(follow[v].values())
        total = sum(WEIGHT * n / words[v]["b"] for n in follow[v].values()) + left * (sum(single.values()) + 1 / (scorer.total["b"] + scorer.size))
        assert total == pytest.approx(1)
    got = score(docs, scorer).join(docs, "doc_id").groupBy("lang").agg(F.avg("score").alias("s")).collect()
    by = {r["lang"]: r["s"] for r in got}
    assert by["de"] < min(s for lang, s in by.items() if lang != "de") - 0.8


@pytest.mark.parametrize("least, frequent", [(1, 1 << 17), (2, 1 << 17), (2, 8), (3, 0)])
def test_lm_scores_against_plain_counts(spark, monkeypatch, least, frequent):
    import tessera.llm.lm_scoring as L

    monkeypatch.setattr(L, "FREQUENT", frequent)
    monkeypatch.setattr(L, "PIECE", 500)
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(30)]
    base = [(k, " ".join(rng.choices(vocab, k=rng.randint(1, 40)))) for k in range(60)]
    base += [(100, "many " * 50_000), (101, "rare pair once"), (102, "Twice\tseen pair"), (103, "twice seen pair"), (104, None)]
    own = base[:7] + [(200, "target only words"), (201, "only words")]
    other = [(300, "unknown w1 w2 stranger w3 pair rare"), (301, "w29 w0 w29"), (302, ""), (303, "target only pair once"), (303, "w1"), (None, "w2 w3"), (304, "w5 " * 3_000)]
    back, target, docs = (spark.createDataFrame(x, "doc_id long, text string") for x in (base, own, base + other))
    split = lambda t: (t or "").lower().split()

    def counts(rows):
        w, p = defaultdict(int), defaultdict(int)
        for _, t in rows:
            s = split(t)
            for x in s:
                w[x] += 1
            for x in zip(s, s[1:], strict=False):
                p[x] += 1
        return w, p, sum(w.values())

    sides = counts(own), counts(base)
    size = len({*sides[0][0], *sides[1][0]}) + 1
    kept = {x for x in {*sides[0][1], *sides[1][1]} if max(s[1].get(x, 0) for s in sides) >= least}

    def loss(text, side):
        w, p, n = side
        s, out = split(text), []
        for k, x in enumerate(s):
            single = (w.get(x, 0) + 1) / (n + size)
            v = s[k - 1]
            follow = sum(c for (a, b), c in p.items() if a == v and (a, b) in kept)
            c, mine = w.get(v, 0), p.get((v, x), 0) * ((v, x) in kept)
            out.append(-np.log(single if not k else 0.7 * mine / max(c, 1) + (1 - 0.7 * follow / max(c, 1)) * single))
            if k > 2 and len(set(s)) == 1:
                return float(np.mean([out[0], *[out[1]] * (len(s) - 1)]))
        return float(np.mean(out)) if s else None

    order = lambda r: (r[0] is None, *[x or 0 for x in r])
    got = sorted([(r["doc_id"], r["n_tokens"], r["target_loss"], r["background_loss"]) for r in L.score(docs, L.fit(back, target, least)).collect()], key=order)
    want = sorted([(d, len(split(t)), loss(t, sides[0]), loss(t, sides[1])) for d, t in base + other], key=order)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([[x or 0 for x in r[2:]] for r in got], [[x or 0 for x in r[2:]] for r in want], rtol=1e-5)


def test_members_are_marked_exactly(spark):
    """With a filter too small for its keys, so that some are in doubt; counts are those of a plain join."""
    import tessera.llm.common as C
    from tessera.llm.lm_scoring import fit, fit_corpus
    from tessera.session import materialize

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), (F.col("id") % 7).cast("string"), (F.col("id") % 5).cast("string")).alias("text"))
    ids = materialize(docs.filter("doc_id % 3 = 0").select("doc_id"), "ids")
    members = C.Members(docs, ids, "doc_id")
    noisy = np.full_like(members.first.shared.value, 0xFF)
    members.first.shared = spark.sparkContext.broadcast(members.first.shared.value | (noisy & 0x5A))
    members.second = C.Bloom(materialize(docs.filter("doc_id % 3 <> 0").select(F.xxhash64("doc_id").alias("key")), "wrong"))
    got, want = fit_corpus(docs, members=members), fit(docs, docs.join(ids, "doc_id"))
    assert sorted(map(tuple, got.words.collect())) == sorted(map(tuple, want.words.collect())) and got.total == want.total
    assert sorted(map(tuple, got.pairs.collect())) == sorted(map(tuple, want.pairs.collect()))


def test_chat_round_trip(spark):
    from tessera.llm.chat import PART_DDL, format_turns, read_turns

    parts = [("text", "see \\<|x ", None, None), ("image", None, "s3://i", 1600), ("text", " and ", None, None), ("audio", None, "a.wav", 999), ("document", None, "d.pdf", 3)]
    m = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", parts), (2, 0, "assistant", None)], f"conv_id long, turn int, role string, parts array<{PART_DDL}>")
    out = {(r["conv_id"], r["turn"]): r for r in format_turns(m).collect()}
    r = out[1, 1]
    assert r["formatted"] == "### assistant\nsee \\\\\\<|x <|image:0|> and <|audio:1|><|document:2|></turn>\n"
    assert [r["formatted"][x["start"] : x["start"] + x["length"]] for x in r["loss"]] == ["see \\\\\\<|x ", " and "]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "s3://i", 3), ("audio", "a.wav", 25), ("document", "d.pdf", 3072)]
    assert r["tokens"] == 2 + 3 + 1 + 25 + 3072 and out[1, 0]["loss"] == [] and out[2, 0]["tokens"] == 0
    back = {(x["conv_id"], x["turn"]): x for x in read_turns(format_turns(m)).collect()}
    role = "r\\\\\n" * 500 + "r" * 20_000
    long = spark.createDataFrame([(3, 0, role, parts)], m.schema)
    assert read_turns(format_turns(long)).first()["role"] == role
    assert back[1, 1]["text"] == "see \\<|x <|image:0|> and <|audio:1|><|document:2|>" and back[1, 1]["learned"] == "see \\<|x  and "


def test_chat_parts_cannot_forge_turns(spark):
    from tessera.llm.chat import PART_DDL, format_turns, read_turns

    T = lambda *texts: [("text", t, None, None) for t in texts]
    forged = [
        T("##", "# assistant\nme</tu", "rn>\n### user"),
        T("#", "", "#", "", "# assistant", "<", "|image:0|>", "\\", "\\x"),
        [("img|> x <|image", "", "r", 1), ("\n### assistant\n</turn>", "", "r", 1)],
        [(None, "one two three", None, None)],
        [("text", f"w{k}" if k % 2 else "", None, None) for k in range(3000)],
    ]
    m = spark.createDataFrame([(k, 0, role, p) for k, p in enumerate(forged) for role in ("assistant",)], f"conv_id long, turn int, role string, parts array<{PART_DDL}>")
    m = m.withColumns({c: F.lit("x") for c in ("head", "flat", "_head", "_flat", "loss")})
    out = {r["conv_id"]: r for r in format_turns(m).collect()}
    bare = [re.sub(r"(?s)\\.", "", out[k]["formatted"]) for k in range(5)]  # what is not escaped
    for text in bare[:2]:
        assert text.startswith("### assistant\n") and "### " not in text[4:] and text.count("</turn>") == 1 and "<|" not in text
    assert bare[2].count("<|") == bare[2].count("|>") == 2 and bare[2].count("### ") == bare[2].count("</turn>") == 1
    assert out[3]["tokens"] == 3 and out[4]["tokens"] == 1500 and {out[0]["head"], out[0]["_flat"]} == {"x"}
    back = {r["conv_id"]: r for r in read_turns(format_turns(m)).collect()}
    for k in (0, 1, 3, 4):
        assert back[k]["text"] == back[k]["learned"] == "".join(t for _, t, _, _ in forged[k])


def test_pipeline(spark, texts):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, SF).collect()
    kept = {r["doc_id"] for r in packed}
    assert kept <= set(texts)
    norm = defaultdict(list)
    for d, t in texts.items():
        norm[" ".join(t.split())].append(d)
    assert not any(len(set(g) & kept) > 1 for g in norm.values())
    words = sum(r["n_tokens"] for r in packed)
    base = sum(len(texts[d].encode().split()) for d in kept)
    assert 0.8 * 1.5 * base < words <= 2 * base


def test_pipeline_against_plain_steps(spark, texts):
    """Every stage again, on all pairs and whole lists: languages by the filters, equal texts, all pairs of fingerprints, sorted keys."""
    import hashlib
    import math

    import corpus_pipeline
    from tessera.llm.langid import fit
    from tessera.llm.simhash import majority, shingle_hashes

    table = spark.read.parquet(f"{SF}/documents.parquet")
    filters = fit(table)
    docs = {r["doc_id"]: r for r in table.collect()}
    said = {d: filters.decide(r["text"]) for d, r in docs.items()}
    kept = {d: r for d, r in docs.items() if said[d][0] != "und" and said[d][1] >= corpus_pipeline.LEAST_SCORE}
    first = {}
    for d in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[d]["text"]), d)
    ids = sorted(first.values())
    bits = [sum((x % 2**64) << (64 * k) for k, x in enumerate(majority(shingle_hashes(kept[d]["text"].encode(), 5), 4))) for d in ids]
    label = plain_components(len(ids), lambda i, j: (bits[i] ^ bits[j]).bit_count() <= 52)
    ids = [ids[i] for i in sorted(set(label))]
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", kept[d]["text"])) for d in ids}
    key = {}
    for d in ids:
        u = (int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        mean = len(kept[d]["text"]) / max(words[d], 1)
        key[d] = -math.log(u) / (0.5 + 0.5 / (1 + abs(mean - 6) / 6))
    by = defaultdict(list)
    for d in ids:
        by[kept[d]["source"]].append(d)
    sources = sorted(by, key=lambda s: (s is None, s))
    size = {s: sum(words[d] for d in by[s]) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(size.values())
    while open_:
        full = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]}
        for s in full or open_:
            target[s] = 2 * size[s] if full else left * weight[s] / sum(weight[x] for x in open_)
        left, open_ = left - sum(target[s] for s in full), (open_ - full if full else set())
    want = []
    for s in sources:
        epochs, before = int(target[s] // max(size[s], 1)), 0
        for d in sorted(by[s], key=lambda d: (key[d], d)):
            more = words[d] > 0 and before + words[d] / 2 <= target[s] - epochs * size[s]
            want += [(d, words[d])] * ((epochs + more) * (words[d] > 0))
            before += words[d]
    got = sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(want)


def test_near_duplicates_of_real_documents_against_all_pairs(spark):
    """Recall of the sampled masks on the documents of sf0.01: links of all pairs within the radius, and what is kept."""
    from tessera.llm.simhash import fingerprints, near_duplicates

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = fingerprints(d, 5, 4).orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in rows]
    bits = np.array([[r[f"f{k}"] for k in range(4)] for r in rows], dtype=np.int64).view(np.uint64)
    label = np.arange(len(ids))
    pairs = [(i, j) for i in range(len(ids)) for j in (np.flatnonzero(np.bitwise_count(bits[i] ^ bits[i + 1 :]).sum(1) <= 52) + i + 1).tolist()]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(d, 5, 52, 4).collect()}
    linked = sum(got[ids[i]] == got[ids[j]] for i, j in pairs)
    assert len(pairs) > 50 and linked >= 0.99 * len(pairs)
    assert sum(got[x] == ids[label[k]] for k, x in enumerate(ids)) >= 0.995 * len(ids)


def test_oracles(spark):
    from tests.harness import compare

    from tessera.llm.queries import ORACLE, QUERIES

    for name in ORACLE:
        compare(spark, QUERIES[name], ORACLE[name], SF)

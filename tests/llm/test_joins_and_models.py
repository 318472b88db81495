"""Sharding, similarity components, language models, toxicity and the pipeline: against plain versions."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import components as C
from palimpsest.llm import kernels as K
from palimpsest.llm import lm_score, ngram_join, pii, queries, shard_ring, toxicity

WORDS = "[^\x20\x09-\x0d]+"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    rows = [(ids[i] if ids else i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


# sharding


def placed(spark, texts, **more):
    return shard_ring.shard_ring(docs(spark, texts), **more).collect()


@pytest.mark.parametrize("n", [0, 5, 333])
def test_counts_are_at_most_one_apart_and_slots_gapless(spark, n):
    texts = [None if i == 3 else "same" if i % 3 == 0 else f"text {i} é" for i in range(n)]
    rows = placed(spark, texts, shards=16, cell_rows=8)
    assert sorted(r["doc_id"] for r in rows) == list(range(n))
    by = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(16)}
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and all(v == list(range(len(v))) for v in by.values())
    for r in rows:
        text = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)


def test_walk_against_one_key_at_a_time():
    r = random.Random(1)
    for _ in range(50):
        shards = r.randrange(2, 6)
        nodes = shard_ring.ring(shards, 4, r.randrange(99))
        owners = [s for _, s in nodes]
        counts = [r.randrange(9) for _ in nodes]
        n = sum(counts)
        room = shard_ring.rooms(n, shards, 0)
        ranges = shard_ring.walk(counts, owners, room)
        got = sorted((a, k, s, first + k - low) for a, low, high, s, first in ranges for k in range(low, high))
        left, want, used = list(room), [], [0] * shards
        waiting = [(a, k) for a, c in enumerate(counts) for k in range(c)]
        for hop in range(len(nodes)):
            later = []
            for a, k in waiting:
                s = owners[(a + hop) % len(nodes)]
                if left[s]:
                    left[s] -= 1
                    want.append((a, k, s, used[s]))
                    used[s] += 1
                else:
                    later.append((a, k))
            waiting = later
        assert got == sorted(want) and not waiting


def test_a_shard_more_moves_few_rows_with_slack(spark):
    texts = [f"text {i}" for i in range(3000)]
    at = lambda n: {r["doc_id"]: r["shard"] for r in placed(spark, texts, shards=n, slack=0.25)}
    before, after = at(8), at(9)
    assert max(np.bincount(list(before.values()))) <= 1.25 * 3000 / 8 + 2
    assert sum(before[i] != after[i] for i in before) < 0.25 * 3000  # 1 / 9 without bounds on the loads


def test_shards_of_repeated_rows_and_clashing_names(spark):
    d = docs(spark, ["same"] * 40 + [None, "other"], [7] * 40 + [1, 2])
    for name in ("size", "shard", "slot", "law", "text_crc32"):
        d = d.withColumn(name, F.lit("mine"))
    rows = shard_ring.shard_ring(d, shards=16).collect()
    sizes = np.bincount([r["shard"] for r in rows], minlength=16)
    assert len(rows) == 42 and sizes.max() - sizes.min() <= 1 and sorted(r["doc_id"] for r in rows) == [1, 2] + [7] * 40


# similarity components


def plain_components(texts, ids, words=3, percent=90):
    sets = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(WORDS, t or "")]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                label[root(i)] = root(j)
    least = {}
    for i in range(len(sets)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return sorted((ids[i], len(sets[i]), least[root(i)]) for i in range(len(sets)))


def near_copies(seed, words, percent):
    """Groups of copies with a few changed words, chains of edits, short texts, shared passages, nulls."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    new = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = new(60)
    out = [None, "", "  \n", "one", "One", "one two", "one two three", "ONE TWO THREE", "one two three four"]
    for _ in range(12):
        base = new(r.choice((9, 12, 40, 120, 300)))
        if r.random() < 0.4:
            base = base + passage
        for _ in range(r.randrange(1, 14)):
            t = list(base)
            for _ in range(r.randrange(0, max(2, int(len(t) * (100 - percent) / 100 / words)))):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            out.append(" ".join(t))
            if r.random() < 0.3:
                base = t  # a chain: far ends link through the middle only
            if r.random() < 0.2:
                out.append(out[-1].upper())
    for i in range(8, 24):
        out.append(" ".join(f"k{j}" for j in range(i)))
    return out


@pytest.mark.parametrize(("seed", "words", "percent", "block"), [(1, 3, 90, 256), (4, 5, 80, 4), (5, 1, 90, 7)])
def test_components_against_brute_force(spark, monkeypatch, seed, words, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    texts = near_copies(seed, words, percent)
    ids = random.Random(seed).sample(range(10_000), len(texts))
    d = docs(spark, texts, ids).withColumn("tokens", F.lit(0)).withColumn("rep", F.lit(0))
    got = ngram_join.jaccard_components(d, words=words, percent=percent).collect()
    assert sorted(map(tuple, got)) == plain_components(texts, ids, words, percent)


@pytest.mark.parametrize("sent", [0, 10**12])
def test_groups_and_signatures_find_the_same_links(spark, monkeypatch, sent):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    plain, wide = ngram_join._unlinked, []

    def priced(rows, keys):
        out = plain(rows, keys)
        if keys == ["group"]:
            wide.append(out.count())
            return out.withColumn("sent", F.lit(sent))  # 0: whole groups are compared, else signatures
        return out

    monkeypatch.setattr(ngram_join, "_unlinked", priced)
    texts = near_copies(4, 5, 80)
    got = ngram_join.jaccard_components(docs(spark, texts), words=5, percent=80).collect()
    assert sorted(map(tuple, got)) == plain_components(texts, list(range(len(texts))), 5, 80) and wide[0] > 0


def test_components_of_nothing_and_of_repeated_rows(spark):
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0
    got = ngram_join.jaccard_components(docs(spark, ["a b c d"] * 3 + [None], [7, 7, 9, 1])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (7, 2, 7), (7, 2, 7), (9, 2, 7)]


def test_components_where_ids_repeat_or_lack(spark):
    texts = near_copies(3, 3, 90)[:60]
    r = random.Random(2)
    ids = [r.choice([None, *range(25)]) for _ in texts]
    rows = [t for t in zip(ids, texts, strict=True)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    by_row = plain_components(texts, list(range(len(texts))))
    for row, size, component in by_row:
        held = [ids[i] for i, _, c in by_row if c == component and ids[i] is not None]
        want.append((ids[row], size, min(held) if held else None))
    assert sorted(map(str, map(tuple, ngram_join.jaccard_components(d).collect()))) == sorted(map(str, want))


def test_linked_sets_share_signatures_and_pass_the_sieve():
    r = np.random.default_rng(7)
    tried = 0
    for percent in (80, 90):
        for _ in range(600):
            n = int(r.integers(4, 160))
            common = np.unique(r.integers(1, 1 << 63, n, dtype=np.uint64))
            most = len(common) * (100 - percent) // percent  # tokens that stand in one of the two sets alone
            left = int(r.integers(0, most + 1))
            right = int(r.integers(0, most - left + 1))
            a, b = (np.unique(np.concatenate([common, r.integers(1, 1 << 63, k, dtype=np.uint64)])) for k in (left, right))
            assert 100 * len(common) >= percent * (len(a) + len(b) - len(common))
            tried += left > 0 and right > 0
            heads = []
            for s in (a, b):
                most = ngram_join.losses(np.array([len(s)]), percent)[0][0]
                heads.append((s[: most + most // 2 + 3], most // 2 + 1))
            both = len(np.intersect1d(heads[0][0], heads[1][0]))
            assert both >= max(heads[0][1], heads[1][1]) or both == min(len(a), len(b))
            df = {int(t): int(r.integers(2, 90)) for t in common}
            one, two = (ngram_join.signatures(len(s), common, np.array([df[int(t)] for t in common]), percent) for s in (a, b))
            short, long = (one, two) if len(a) <= len(b) else (two, one)
            # the smaller set probes (or indexes, if its class is the same), the larger one is met by what either side indexes
            shared = np.intersect1d(short[0], long[0])
            indexed = np.union1d(short[0][short[1]], long[0][long[1]])
            assert len(np.intersect1d(shared, indexed))
    assert tried > 100


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in C.components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}


# language models


def test_language_model_against_plain_counts(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["the", "a", "cat", "dog", f"rare{r.randrange(30)}"]) + r.choice(["", ",", "."]) for _ in range(r.randrange(1, 40))) for _ in range(60)] + [None, "", "..."]
    targets = list(range(0, 60, 3))
    d = docs(spark, texts)
    model = lm_score.train(d, spark.createDataFrame([(i,) for i in targets + [0]], "doc_id long"), word_share=0.01, pair_share=0.005)
    cut = [re.findall("[0-9A-Za-z]+", (t or "").lower()) for t in texts]
    total = sum(map(len, cut))
    count = lambda which, f: sum(f(cut[i]) for i in which)
    every = range(len(texts))
    words = {w for c in cut for w in c}
    kept = {w for w in words if count(every, lambda c, w=w: c.count(w)) >= max(1, 0.01 * total)}
    ids = [[w if w in kept else None for w in c] for c in cut]
    scale = sum(len(cut[i]) for i in targets) / total
    loss = []
    for which, by in ((targets, 1.0), (every, scale)):
        single = {w: by * sum(ids[i].count(w) for i in which) for w in [*kept, None]}
        size = sum(single.values())
        p1 = {w: (n + 100 / len(single)) / (size + 100) for w, n in single.items()}
        pair, all_pairs = {}, {}
        for i in every:
            for x in zip(ids[i], ids[i][1:], strict=False):
                all_pairs[x] = all_pairs.get(x, 0) + 1
                pair[x] = pair.get(x, 0) + (by if i in set(which) else 0)
        held = {x: max(n - 0.75, 0) / max(single[x[0]], n, 1e-9) for x, n in pair.items() if all_pairs[x] >= max(1, 0.005 * total)}
        rest = {w: 1 - sum(v for x, v in held.items() if x[0] == w) for w in single}
        loss.append([-sum(math.log((rest[c[j - 1]] * p1[w] + held.get((c[j - 1], w), 0)) if j else p1[w]) for j, w in enumerate(c)) / max(1, len(c)) for c in ids])
    for r_ in lm_score.score_documents(d, model).collect():
        i = r_["doc_id"]
        if not cut[i]:
            assert r_["n_tokens"] == 0 and r_["score"] is None
        else:
            assert r_["n_tokens"] == len(cut[i]) and r_["target_loss"] == pytest.approx(loss[0][i]) and r_["score"] == pytest.approx(loss[0][i] - loss[1][i])


def test_models_sum_to_one(spark):
    d = docs(spark, ["a b a c a b b", "c c a b", "a"])
    m = lm_score.train(d, spark.createDataFrame([(0,)], "doc_id long"))
    size = len(m.words) + 1
    for model in range(2):
        for first in range(size):
            total = sum(m.left[model, first] * m.single[model, w] for w in range(size)) + m.paired[model][m.pairs // size == first].sum()
            assert total == pytest.approx(1)
    assert lm_score.score_documents(d.limit(0), lm_score.train(d.limit(0), spark.createDataFrame([], "doc_id long"))).count() == 0
    assert lm_score.score_documents(d, lm_score.train(d, spark.createDataFrame([], "doc_id long"))).count() == 3


def test_scores_of_the_whole_corpus_are_those_of_a_model_that_drops_nothing(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 90)
    monkeypatch.setattr(lm_score, "PART_TOKENS", 60)
    monkeypatch.setattr(K.chunks, "__defaults__", (300,))
    r = random.Random(5)
    texts = [" ".join(r.choice(["the", "a", "cat", f"rare{r.randrange(90)}"]) for _ in range(r.randrange(40))) for _ in range(50)] + [None, "", "..."]
    for ids in ([], [*range(0, 50, 3), 51]):
        d, targets = docs(spark, texts), spark.createDataFrame([(i,) for i in ids], "doc_id long")
        want = {x["doc_id"]: x for x in lm_score.score_documents(d, lm_score.train(d, targets, word_share=0.0, pair_share=0.0)).collect()}
        got = lm_score.score_corpus(d, targets).collect()
        assert len(got) == len(want) == 53
        for x in got:
            assert tuple(x) == pytest.approx(tuple(want[x["doc_id"]]))
    assert lm_score.score_corpus(d.limit(0), targets).count() == 0


def test_a_rare_bigram_of_a_long_corpus_counts(spark, tmp_path):
    texts = ["the cat " * 50_000] * 30 + ["rare bigram"] * 2
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(30, 1)], "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x["doc_id"]: x for x in queries.op7_lm_score(spark, str(tmp_path)).collect()}
    size = 2.0  # tokens of the target; background counts are scaled to it
    single = lambda n: (n + 100 / 5) / (size + 100)
    by = size / 3_000_004
    loss = []
    for n in (1.0, 2 * by):
        pair = max(n - 0.75, 0) / n
        loss.append(-(math.log(single(n)) + math.log((1 - pair) * single(n) + pair)) / 2)
    assert (got[31]["target_loss"], got[31]["background_loss"]) == (pytest.approx(loss[0]), pytest.approx(loss[1]))


# toxicity


def plain_segments(values):
    """The maximal segments by their definition: the best one, then those left and right of it."""
    best = None
    for i in range(len(values)):
        for j in range(i + 1, len(values) + 1):
            s = sum(values[i:j])
            if s > 0 and (best is None or s > best[0] or s == best[0] and (j - i) < best[2] - best[1]):
                best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    return plain_segments(values[:i]) + [(i, j, s)] + [(a + j, b + j, v) for a, b, v in plain_segments(values[j:])]


def test_maximal_segments():
    r = random.Random(4)
    assert toxicity.maximal_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1, 4), (2, 3, 3), (4, 11, 7)]
    for _ in range(600):
        values = [r.choice([-1, 1]) * (r.randrange(1, 1000) + r.randrange(1, 1000) / 1009) for _ in range(r.randrange(14))]
        got = toxicity.maximal_segments(values)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain_segments(values)]
        assert all(v == pytest.approx(sum(values[a:b])) for a, b, v in got)


def toxic_corpus(spark, n=900):
    r = random.Random(6)
    vocabulary = [f"word{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(n):
        t = [r.choice(vocabulary) for _ in range(r.randrange(5, 200))]
        bad = r.random() < 0.2
        if bad:
            at = r.randrange(len(t))
            for k in range(4):
                t.insert(min(len(t), at + 2 * k), r.choice(["nasty", "vile", f"foul{r.choice('abcdef')}x"]))
        texts.append(" ".join(t))
        labels.append((i, 1, int(bad)))
    return docs(spark, [*texts, None, "", "..."]), spark.createDataFrame(labels, "doc_id long, quality long, toxic long")


def test_toxicity_on_held_out_documents(spark):
    d, labels = toxic_corpus(spark)
    model = toxicity.train(d, labels)
    rows = {r["doc_id"]: r for r in toxicity.score_documents(d, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in truth if rows[i]["held_out"]} == set(held)
    assert np.mean([rows[i]["predicted"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values()) and len(rows) == 903
    some = next(r for i, r in rows.items() if truth.get(i) and r["n_passages"])
    words = re.findall("[0-9a-z]+", d.filter(F.col("doc_id") == some["doc_id"]).first()["text"])
    found = words[some["passages"][0]["first"] : some["passages"][0]["end"]]
    assert any(w in ("nasty", "vile") or w.startswith("foul") for w in found)


def test_held_out_labels_teach_nothing(spark):
    d, labels = toxic_corpus(spark, 300)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(d, labels), toxicity.train(d, turned)
    assert a.weights == b.weights and np.array_equal(a.features, b.features) and np.array_equal(a.scores, b.scores)


def test_toxicity_without_labels(spark):
    d, labels = toxic_corpus(spark, 40)
    for some in (labels.limit(0), labels.withColumn("toxic", F.lit(0))):
        assert {r["predicted"] for r in toxicity.score_documents(d, toxicity.train(d, some)).collect()} == {0}
    assert toxicity.score_documents(d.limit(0), toxicity.train(d, labels)).count() == 0


def test_feature_counts_do_not_depend_on_what_a_task_holds(monkeypatch):
    r = random.Random(9)
    texts = [" ".join(f"word{r.randrange(300)}" for _ in range(r.randrange(900))) for _ in range(40)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array([i % 3 == 0 for i in range(42)]), pa.array(texts)], names=["toxic", "text"])

    def total():
        out = {}
        for b in toxicity._feature_counts(iter([batch, batch.slice(5, 9)])):
            for key, *n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                out[key] = tuple(np.add(out.get(key, (0, 0)), n).tolist())
        return out

    want = total()
    monkeypatch.setattr(toxicity, "HELD", 100)
    monkeypatch.setattr(toxicity, "COUNTED_BYTES", 3000)
    assert total() == want and len(want) > 300


def test_models_do_not_look_at_other_columns(spark):
    d, labels = toxic_corpus(spark, 200)
    odd = d
    for name in ("score", "toxic", "target", "__target", "n_tokens", "feature", "key"):
        odd = odd.withColumn(name, F.lit("mine"))
    more = labels.withColumn("text", F.lit("mine"))
    scored = lambda x, y: sorted(map(str, toxicity.score_documents(x, toxicity.train(x, y)).collect()))
    assert scored(d, labels) == scored(odd, more)
    losses = lambda x, y: sorted(map(str, lm_score.score_corpus(x, y.filter("toxic = 1")).collect()))
    assert losses(d, labels) == losses(odd, more)


def test_learning_is_bounded_by_rows_and_bytes(spark):
    d, labels = toxic_corpus(spark, 400)
    few = toxicity.train(d, labels, most_bytes=20_000)
    assert len(few.features) < len(toxicity.train(d, labels).features)
    assert len(toxicity.train(d, labels, most_labelled=30).features) < 20


# SQL and the pipeline


@pytest.mark.parametrize("name", ["op2_decontamination", "op6_host_rules", "op10_ngram_join"])
def test_queries_match_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    want = con.execute(queries.ORACLES[name])
    order = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    r = random.Random(8)
    clean = lambda: " ".join(r.choice(["alpha", "bravo", "charlie", "delta", "echo", "golf", "hotel", "india", "kilo", "lima"]) for _ in range(60))
    good = [clean() for _ in range(40)]
    item = " ".join(f"bench{i}" for i in range(20))
    texts = [*good, "too short", "# $ % & " * 30, good[0], good[0].replace("alpha", "Alpha", 1), good[1] + " " + item, clean() + " and mail me@example.org, card 4111 1111 1111 1111", None, ""]
    folder = str(tmp_path / "sf")
    d = docs(spark, texts)
    d.unionByName(d.filter("doc_id = 5")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/{i}")
        now = spark.read.parquet(f"{folder}/{i}")
        if i < len(pipeline.STAGES) - 1:
            assert now.columns == d.columns
        kept[name] = sorted(r["doc_id"] for r in now.collect())
    assert kept["quality"] == sorted([*range(40), 5, 42, 43, 44, 45])
    assert kept["near_duplicates"][:40] == list(range(40)) and 42 not in kept["near_duplicates"] and 43 not in kept["near_duplicates"]
    assert 44 not in kept["decontaminate"]
    masked = spark.read.parquet(f"{folder}/3").filter("doc_id = 45").first()
    assert masked["text"] == texts[45].replace("me@example.org", "<EMAIL>").replace("4111 1111 1111 1111", "<CARD>") and masked["n_chars"] == len(masked["text"])
    assert [tuple(x) for x in spark.read.parquet(f"{folder}/3").filter("doc_id <> 45").orderBy("doc_id").collect()] == [tuple(x) for x in spark.read.parquet(f"{folder}/2").filter("doc_id <> 45").orderBy("doc_id").collect()]
    assert sorted(map(str, now.collect())) == sorted(map(str, pipeline.run(spark, folder).collect()))


def test_pipeline_stages_on_nothing_nulls_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as pipeline

    folder = str(tmp_path / "sf")
    spark.createDataFrame([(0, "some item of the benchmark")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    r = random.Random(3)
    long = lambda: " ".join(r.choice(["alpha", "bravo", "charlie", "delta", "echo", "golf"]) for _ in range(60))
    one, two, three = long(), long(), long()
    rows = [(1, one), (1, two), (2, one), (None, three), (None, None), (3, two), (3, two), (4, None), (4, "")]
    for some in (rows, []):
        d = spark.createDataFrame([(i, t, "en", None, None, 5) for i, t in some], COLUMNS + ", kept int")
        for name, stage in pipeline.STAGES:
            out = stage(spark, d, folder).collect()
            if name == "near_duplicates" and some:
                assert sorted(map(str, [(x["doc_id"], x["text"]) for x in out])) == sorted(map(str, [(1, one), (1, two), (None, three), (None, None), (4, None), (4, "")]))
            elif name != "quality":
                assert len(out) == len(some)


def test_masks_cover_overlapping_spans():
    assert pii.mask("on 10.0.0.0 4111 1111 1111 1111 and a@b.c") == "on <IP> and <EMAIL>"


def test_empty_chunks():
    assert list(K.chunks(pa.array([], pa.string()))) == []
    assert [len(c.offsets) for c in K.chunks(pa.array([None, None], pa.string()))] == [3]

"""Conversation repair, whitening and license scans: against plain versions."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import license_scan, queries, turn_repair, whitening

INK = re.compile(r"[^\x20\x09-\x0D]")
PATTERN = re.compile("(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}

# conversation repair


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        code = zlib.crc32(":".join(shown).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def plain_plan(rows):
    """The counts, audit and hash of one conversation's damaged rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults = []
    for i, (_, role, text) in enumerate(rows):
        ink = INK.findall(text)
        blank, again = not ink, any((role, text) == r[1:] for r in rows[:i])
        faults.append("blank" if blank else "duplicate" if again else "truncated" if ink[-1] not in ".!?" else None)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))

    @lru_cache(None)
    def best(i, last, inserts):
        """Least (cost, audit, lines) from row i on, where the retained roles so far end in `last`."""
        ends = [] if last in "su" and last else [(0, "", ())]  # a pair is open after u, and wanted after s
        ways = ends if i == len(rows) else []
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if inserts < 4:
            for q in set(follows) - {"s"}:
                c, a, lines = best(i, q, inserts + 1)
                ways.append((c + 2, "I" + a, (NAMES[q] + ":", *lines)))
        if i < len(rows):
            c, a, lines = best(i + 1, last, 0)
            ways.append((c + 3, "D" + a, lines))
            _, role, text = rows[i]
            if faults[i] not in ("blank", "duplicate"):
                for q in follows:
                    for edit, price, name in (("K", 0, role), ("R", 2, NAMES.get(q))):
                        if (edit == "K" and role[:1] == q) or (edit == "R" and name):
                            c, a, lines = best(i + 1, q, 0)
                            ways.append((c + price + (faults[i] == "truncated"), edit + a, (f"{name}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    roles = "".join(x[0] for x in lines)
    assert PATTERN.fullmatch(roles)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


SCHEMA = "conv_id long, turn long, role string, text string"


def random_conversations(seed, n):
    r, out = random.Random(seed), []
    for conv in [None, *range(n)]:
        for turn in range(r.randrange(1, 12)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "é"])
            text = r.choice(["Yes.", "No!", "Why?", "cut", " \n", "", None, "Ünd. ", "same.", "long " * 3000 + "."])
            out.append((conv, r.choice([turn, turn, turn, None, -5, turn // 2]), role, text))
    r.shuffle(out)
    return out


def test_plans_against_a_plain_search(spark):
    rows = random_conversations(5, 120)
    want = {conv: plain_plan([x[1:] for x in plain_damage(rows) if x[0] == conv]) for conv in {r[0] for r in rows}}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    damaged = turn_repair.damage(df)
    plans = turn_repair.plan_repairs(damaged, present="present")
    assert {r[0]: tuple(r)[1:] for r in plans.collect()} == want
    turns = {}
    for r in turn_repair.repaired_turns(damaged, plans, present="present").collect():
        turns.setdefault(r["conv_id"], []).append((r["place"], f"{r['role']}:{r['text']}", r["edit"], r["turn"]))
    for conv, plan in want.items():
        got = sorted(turns.get(conv, []), key=lambda x: x[0])
        assert [g[0] for g in got] == list(range(len(got)))
        assert hashlib.sha256("\n".join(g[1] for g in got).encode()).hexdigest() == plan[-1]
        assert "".join(g[2] for g in got) == plan[-2].replace("D", "") and all(g[3] is None for g in got if g[2] == "I")


def test_ties_go_to_the_least_audit():
    for roles in ("uu", "aa", "ss", "sau", "usu", "uauuaaus", "tt", "aaauuu", "suuu"):
        rows = [(i, {"u": "user", "a": "assistant", "s": "system", "t": "tool"}[c], f"line {i}.") for i, c in enumerate(roles)]
        one = turn_repair.Repair()
        for turn, role, text in rows:
            one.take(turn, role.encode(), text.encode())
        counts, audit, digest = one.end()
        assert (*counts, audit, digest) == plain_plan(rows), roles


def test_a_conversation_across_batches_and_one_without_rows(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"line {i}.") for i in range(5000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        gone = [(9, 0, "user", "x", False)]
        df = spark.createDataFrame([(*r, True) for r in rows] + gone, SCHEMA + ", there boolean")
        found = {r["conv_id"]: r for r in turn_repair.plan_repairs(df, present="there").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[7]["audit"] == "K" * 5000 and found[7]["cost"] == 0
    assert tuple(found[9])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_of_odd_tables(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    df = spark.createDataFrame([(1, low, "user", "a."), (1, high, "assistant", "b.")], SCHEMA)
    clashing = df.withColumns({c: F.lit("x") for c in ("present", "audit", "gaps", "__turn", "place")})
    assert [tuple(r)[:2] for r in turn_repair.plan_repairs(clashing).collect()] == [(1, high)]
    assert turn_repair.plan_repairs(turn_repair.damage(df.limit(0)), present="present").count() == 0


def test_repair_query(spark, tmp_path):
    rows = random_conversations(6, 40)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r[0]: tuple(r)[1:] for r in queries.op11_turn_repair(spark, str(tmp_path)).collect()}
    assert got == {conv: plain_plan([x[1:] for x in plain_damage(rows) if x[0] == conv]) for conv in {r[0] for r in rows}}


# whitening


def plain_whitening(vectors, components=8):
    x = np.floor(vectors * 1024).astype(np.int64) + 100000
    n, d = x.shape
    r = n * x.astype(object) - x.astype(object).sum(axis=0)
    v = np.array((r.T @ r).tolist(), dtype=float) / float(n) ** 3
    values, own = np.linalg.eigh(v)
    values, own = values[::-1][:components], own[:, ::-1][:, :components]
    return n, (r * r).sum(axis=1), (r.astype(float) / n) @ own / np.sqrt(values), values / np.trace(v)


def embeddings(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")


def test_whitening_against_exact_numbers(spark):
    r = np.random.default_rng(3)
    vectors = (r.normal(size=(700, 12)) @ r.normal(size=(12, 12))).astype(np.float32)
    vectors[5] = vectors[6]
    odd = [None, [], [1.0] * 11 + [None], [1.0] * 11 + [float("nan")], [float("inf")] + [1.0] * 11, [1.0] * 5, [3e30] * 12]
    rows = [v.tolist() for v in vectors] + odd
    ids = [None if i == 9 else 3 if i in (5, 6) else i for i in range(len(rows))]
    df = embeddings(spark, rows, ids).repartition(5).withColumns({c: F.lit(1) for c in ("n", "component", "deviation", "label")})
    got = whitening.whiten(df).collect()
    n, deviation, whitened, explained = plain_whitening(vectors.astype(float))
    assert len(got) == 8 * n and {g["n"] for g in got} == {n}
    by = {}
    for g in got:
        by.setdefault(g["vec_id"], []).append(g)
    assert len(by[3]) == 24 and len(by[None]) == 8  # rows 3, 5 and 6 share an id
    sign = None
    for i in range(n):
        if i in (3, 5, 6):
            continue
        mine = sorted(by[ids[i]], key=lambda g: g["component"])
        assert [g["component"] for g in mine] == list(range(1, 9)) and {g["deviation"] for g in mine} == {deviation[i]}
        w = np.array([g["whitened"] for g in mine])
        sign = np.sign(w * whitened[i]) if sign is None else sign
        assert np.allclose(w * sign, whitened[i], rtol=0, atol=1e-9)
        assert np.allclose([g["explained"] for g in mine], explained, rtol=1e-9) and mine[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("largest,n,d", [(1, 1, 1), (1 << 20, 500, 70), ((1 << 52) - 1, 40, 3), (7, 40_000, 2)])
def test_residues_give_back_the_exact_scatter(spark, largest, n, d):
    r = np.random.default_rng(d)
    x = r.integers(-largest, largest + 1, size=(n, d))
    chosen = whitening.primes_for(n, largest)
    want = x.astype(object).T @ x.astype(object)
    assert (whitening.rebuilt([whitening.residue_scatter(x, p) for p in chosen], chosen) == want).all()
    if n <= 500:
        df = embeddings(spark, (x / 1024).tolist()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")) if largest < 1 << 24 else None
        if df is not None:
            kept, count, dimension, top = whitening.usable(df, "vec_id", "embedding")
            got = whitening.exact_scatter(kept, count, dimension, top)
            y = np.hstack([np.ones((n, 1), np.int64), whitening.whole(np.array((x / 1024).astype(np.float32), np.float64))]).astype(object)
            assert (got == y.T @ y).all()


def test_primes_hold_what_is_asked_of_them():
    found = whitening.primes(16)
    assert len(set(found)) == 16 and all(p < 1 << 20 and all(p % q for q in range(2, 1024)) for p in found)
    assert whitening.BLOCK * (max(found) // 2) ** 2 <= 1 << 53
    with pytest.raises(ValueError):
        whitening.primes_for(1 << 250, 1 << 52)


def test_deviations_past_the_fast_path():
    x = np.array([[1 << 40, 3], [-(1 << 40), 5], [0, 1]])
    sums = x.astype(object).sum(axis=0)
    for n in (3, 1 << 10, 1 << 30):
        r, squares = whitening.residuals(x, n, sums, 1 << 40)
        want = [sum(int(v) ** 2 for v in n * row.astype(object) - sums) for row in x]
        assert squares == [v if v < 1 << 63 else None for v in want]
        assert np.allclose(r, (n * x.astype(object) - sums).astype(float))


def test_whitening_of_odd_tables(spark):
    one = whitening.whiten(embeddings(spark, [[0.5, 1.0, 2.0]] * 3)).collect()
    assert len(one) == 9 and {(g["n"], g["deviation"], g["whitened"], g["explained"], g["identity_error"]) for g in one} == {(3, 0, None, None, None)}
    flat = whitening.whiten(embeddings(spark, [[0.0, 1.0], [2.0, 1.0], [4.0, 1.0]])).collect()
    assert {(g["component"], g["whitened"] is None) for g in flat} == {(1, False), (2, True)} and {g["explained"] for g in flat} == {1.0, 0.0}
    for none in (embeddings(spark, [None, [None], [float("nan")]]), embeddings(spark, [[1.0]]).limit(0)):
        assert whitening.whiten(none).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and whitening.whiten(none).count() == 0


def test_whitening_query(spark, tmp_path):
    vectors = np.random.default_rng(8).normal(size=(300, 10)).astype(np.float32)
    embeddings(spark, vectors.tolist()).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_whitening(spark, str(tmp_path)).orderBy("vec_id", "component").collect()
    n, deviation, whitened, explained = plain_whitening(vectors.astype(float))
    assert [g["deviation"] for g in got[::8]] == list(deviation)
    assert np.allclose(np.abs([g["whitened"] for g in got]).reshape(n, 8), np.abs(whitened), atol=1e-9) and np.allclose([g["explained"] for g in got[:8]], explained)


# license scans

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
DOCUMENTS = "doc_id long, text string, lang string"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_base(text):
    w, starts, labels = words(text), [], set()
    for phrase, label in BASE:
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += hits
        labels |= {label} if hits else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def plain_share(text, template, k=license_scan.NOTICE_WORDS):
    """The greatest share of a template that one run of near diagonals covers."""
    w, t = words(text), words(template.text)
    places = {}
    for i in range(len(w) - k + 1):
        for j in range(len(t) - k + 1):
            if w[i : i + k] == t[j : j + k]:
                places.setdefault(i - j, set()).add(j)
    drift, best, run, before = min(4, len(t) // license_scan.SHORT), 0.0, set(), None
    for diagonal in sorted(places):
        run = run | places[diagonal] if before is not None and diagonal - before <= drift else set(places[diagonal])
        before = diagonal
        best = max(best, len({j + x for j in run for x in range(k)}) / len(t))
    return best if best >= (1 if len(t) < license_scan.SHORT else 0.8) else 0.0


def plain_scan(text):
    n, places, low, high, labels = plain_base(text)
    shares = {(x.label, x.text): plain_share(text, x) for x in license_scan.NOTICES}
    own = {label for (label, _), s in shares.items() if s}
    score = max([license_scan.NAME_SCORE if places else 0.0, *shares.values()])
    return n, places, low, high, labels, ",".join(sorted(own | set(filter(None, labels.split(","))))), score


def noisy(r, text):
    w = text.split()
    for _ in range(r.randrange(4)):
        at = r.randrange(len(w))
        w[at : at + r.randrange(2)] = r.choice([[], ["or"], ["the", "said"]])
    return " ".join(w)


def test_scan_against_all_pairs_of_places(spark, tmp_path):
    r = random.Random(2)
    filler = "the of license under mit apache general public terms word é x".split()
    texts = [None, "", "!!", "mit", "MIT LICENSE", "mit license mit\nlicense, General Public License general public", "x " * 20_000 + "Apache-License " + "y " * 9_000 + "mit license"]
    for _ in range(60):
        parts = [" ".join(r.choices(filler, k=r.randrange(30)))]
        for _ in range(r.randrange(3)):
            parts += [noisy(r, r.choice(license_scan.NOTICES).text), " ".join(r.choices(filler, k=r.randrange(30)))]
        texts.append(" ".join(parts))
    texts += texts[:9]
    ids = [None if i % 11 == 5 else i % 40 for i in range(len(texts))]
    spark.createDataFrame([(i, t, "en") for i, t in zip(ids, texts, strict=True)], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = sorted((str(x["doc_id"]), str(tuple(x[c] for c in columns))) for x in queries.op13_license_scan(spark, str(tmp_path)).collect())
    assert got == sorted((str(i), str(plain_scan(t))) for i, t in zip(ids, texts, strict=True))
    assert sum("'mit'" in g[1] for g in got) > 3


def test_near_namesakes_are_other_licenses(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCUMENTS).withColumns({c: F.lit(0) for c in ("n_words", "label", "hash", "__key")})
    got = {x["doc_id"]: (x["labels"], x["base_labels"], x["score"]) for x in license_scan.scan_licenses(df).collect()}
    assert got == {0: ("cc-by-nc", "", 1.0), 1: ("cc-by-nc-sa", "", 1.0), 2: ("cc-by-sa", "", 1.0)}


def test_spans_of_a_changed_notice(spark):
    mit = next(x for x in license_scan.NOTICES if x.text.startswith("Permission is hereby"))
    w = mit.text.split()
    text = "start " + " ".join(w[:20] + ["kindly"] + w[20:40] + w[41:]) + " end"
    df = spark.createDataFrame([(1, text, "en")], DOCUMENTS)
    (span,) = license_scan.spans(df).collect()
    assert (span["label"], span["first"], span["last"]) == ("mit", 1, len(words(text)) - 2) and 0.8 <= span["covered"] < 1
    assert license_scan.scan_licenses(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.template_places(spark, (license_scan.Template("x", "two words"),))


# language models over blocks without pairs or words, and main texts beside comments


@pytest.mark.parametrize("texts", [["one", "two"], [None, "", "!?"], [None, "", "one", "one two three", "two", "", "long word " * 5000, "one"]])
def test_blocks_without_pairs_or_words(spark, monkeypatch, texts):
    from palimpsest.llm import lm_score

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(len(texts))
    targets = df.where("doc_id <= 3")
    for tokens in (1, 1 << 21):
        monkeypatch.setattr(lm_score, "BLOCK_TOKENS", tokens)
        monkeypatch.setattr(lm_score, "PART_TOKENS", max(tokens, 100))
        got = {r[0]: tuple(r)[1:] for r in lm_score.score_corpus(df, targets).collect()}
        assert sorted(got) == list(range(len(texts)))
        want = {r[0]: tuple(r)[1:] for r in lm_score.score_documents(df, lm_score.train(df, targets, word_share=0, pair_share=0)).collect()}
        for i, t in enumerate(texts):
            n = len(words(t))
            assert got[i][0] == n and (got[i][1:] == (None, None, None) if not n else np.allclose(got[i][1:], want[i][1:], rtol=1e-9))


STORY = "<p>The story goes on and on with many words in it, and then it ends here.</p>"
WRAPPERS = ['ol class="comment-list"', 'div class="comments-area"', 'section id="user-comments"', 'div class="ad-slot"', 'div class="share-buttons"', 'div role="form"', 'div role="dialog"', "div hidden", 'div aria-hidden="true"', 'div style="display: none"', "form"]


@pytest.mark.parametrize("opening", WRAPPERS)
def test_what_is_set_apart_goes_unless_it_holds_the_content(opening):
    from palimpsest.llm.html_main import main_text

    tag = opening.split()[0]
    part = f"<{opening}><li>reader says {'word ' * 40}</li></{tag}>"
    for page in (f"<article>{STORY * 3}{part}</article>", f"<main>{STORY * 3}{part}</main>", f"<div>{STORY * 3}</div>{part}", f"<article>{STORY * 3}</article>{part * 20}"):
        assert main_text(f"<body>{page}</body>") == "\n".join([re.sub("<.*?>", "", STORY)] * 3)
    assert main_text(f"<body><{opening}><article>{STORY * 3}</article></{tag}></body>").count("story") == 3
    assert main_text(f"<body><{opening}>{STORY * 3}</{tag}></body>").count("story") == (0 if "comment" in opening else 3)


def test_comments_that_are_articles_and_names_that_say_no():
    from palimpsest.llm.html_main import main_text

    page = f'<body><article>{STORY * 3}</article><ol class="comment-list"><li><article class="comment-body">reader says {STORY * 30}</article></li></ol></body>'
    assert main_text(page).count("story") == 3 and "reader" not in main_text(page)
    page = f'<body><div class="content has-sidebar">{STORY * 3}<div class="no-ads"><div class="page-widget">{STORY}</div></div></div></body>'
    assert main_text(page).count("story") == 4

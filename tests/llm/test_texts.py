"""Decontamination, language-model scores, personal data, mixing, chats, quality and toxicity."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewfold.llm import chat, decontam, lmscore, mixing, pii, quality, toxicity
from viewfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# decontamination


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def slow_contamination(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                for i in wins.get(tuple(w[k : k + n]), ()):
                    got.add(i)
                    hit.update(range(k, k + n))
        out[d] = (len(w), len(hit), sorted(got))
    return out


def contamination_rows(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(30)] + ["the", "of"]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 25)))) for k in range(15)] + [(90, ""), (91, "...")]
    docs = []
    for d in range(60):
        parts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 30)))]
        if rnd.random() < 0.5:
            t = rnd.choice(items)[1].split()
            k = rnd.randint(0, len(t))
            parts.append(" ".join(t[k:]).upper())
        docs.append((d, ", ".join(parts)))
    return [*docs, (900, None), (901, ""), (902, items[0][1])], items


@pytest.mark.parametrize("slice_chars", [64_000_000, 100])
def test_contamination_equals_brute_force(spark, slice_chars):
    docs, items = contamination_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1))
    b = spark.createDataFrame([*items, (None, "w1 w2"), items[0]], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.find_contamination(df, b, slice_chars=slice_chars).collect()}
    assert got == slow_contamination(docs, items)


@pytest.mark.parametrize("slice_chars", [64_000_000, 100])
def test_rows_that_share_an_id_keep_their_own_matches(spark, slice_chars):
    docs, items = contamination_rows(3)
    texts = [t for _, t in docs] + [docs[1][1], docs[1][1], items[0][1], items[1][1]]
    texts += [" ".join(reversed((t or "").split())) for t in texts[:20]]
    ids = [None if k % 3 == 0 else 5 for k in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.find_contamination(df, b, slice_chars=slice_chars).collect()]
    each = slow_contamination(list(enumerate(texts)), items)
    assert sorted(map(str, got)) == sorted(str((i, *each[k])) for k, i in enumerate(ids))


def test_index_of_all_terms_and_small_shards(spark, monkeypatch):
    docs, items = contamination_rows(5)
    monkeypatch.setattr(decontam, "SHARD_DOCS", 7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    wins = spark.sparkContext.broadcast(decontam.windows_of([(str(i), t.encode()) for i, t in items]))
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.search(decontam.build_index(df), wins).collect()}
    assert got == slow_contamination(docs, items)


def test_near_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    swapped = "x alpha beta delta gamma epsilon eta zeta theta iota kappa y"
    rows = [(1, item), (2, swapped), (3, "alpha " + "x " * 50 + "beta gamma")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in decontam.find_contamination(df.unionByName(df.select((F.col("doc_id") + 10).alias("doc_id"), F.concat(F.lit("pad " * 20), "text", F.lit(" pad" * 20)).alias("text"))), b, near_span=12).collect()}
    assert got[1][0] == ["7"] and got[2][0] == [] and got[12] == ([], ["7"]) and got[13] == ([], [])


def slow_near(docs, items, span, terms=4):
    count = Counter(w for _, t in set(items) for w in words(t))
    out = {}
    for d, t in docs:
        w, got = words(t), set()
        for i, x in items:
            v = words(x)
            for k in range(max(1, len(v) - 9) if v else 0):
                rare = sorted(set(v[k : k + 10]), key=lambda y: (count[y], y.encode()))[:terms]
                at = {y: [p for p, z in enumerate(w) if z == y] for y in rare}
                if any(all(any(abs(p - q) <= span for q in at[y]) for y in rare) for p in at[rare[0]]):
                    got.add(str(i))
        out[d] = sorted(got)
    return out


@pytest.mark.parametrize("slice_chars", [64_000_000, 100])
def test_near_matches_end_at_documents_and_are_the_same_in_every_shard(spark, monkeypatch, slice_chars):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    swapped = "x alpha beta delta gamma epsilon eta zeta theta iota kappa y"
    other = " ".join(f"o{k}" for k in range(30))
    rows = [(1, item), (2, swapped), (3, "alpha beta gamma"), (4, "delta epsilon zeta eta theta iota kappa"), (5, "alpha " + "x " * 50 + "beta"), (6, "zeta beta alpha gamma delta lambda epsilon"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(7, item), (8, other), (9, "kappa iota theta " * 9)], "item_id long, text string")
    # of item 7 the words alpha to eta occur once in the benchmark, so alpha, beta, delta and epsilon are chosen
    for size in (4096, 1):
        monkeypatch.setattr(decontam, "SHARD_DOCS", size)
        got = {r.doc_id: [x for x in r.near_items if x == "7"] for r in decontam.find_contamination(docs, b, near_span=12, slice_chars=slice_chars).collect()}
        assert got == {1: ["7"], 2: ["7"], 3: [], 4: [], 5: [], 6: ["7"], 7: []}


def test_near_matches_equal_brute_force(spark):
    docs, items = contamination_rows(9)
    found = decontam.find_contamination(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"), near_span=10)
    got = {r.doc_id: r for r in found.collect()}
    assert {d: r.near_items for d, r in got.items()} == slow_near(docs, items, 10)
    assert all(set(r["items"]) <= set(r.near_items) for r in got.values()) and any(r.near_items != r["items"] for r in got.values())


def test_near_items_query(spark):
    got = QUERIES["op4_near_items"](spark, SF).collect()
    assert len(got) == read(spark, "documents").count() and all(r.n_near > 0 for r in got if r.n_hit > 0)


def test_contamination_of_empty_tables(spark):
    df = read(spark, "documents")
    assert decontam.find_contamination(df.limit(0), read(spark, "benchmark")).count() == 0
    none = decontam.find_contamination(df, read(spark, "benchmark").limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == df.count()
    assert decontam.drop_contaminated(df, read(spark, "benchmark")).columns == df.columns


@pytest.mark.parametrize("slice_chars", [decontam.SLICE_CHARS, 100])
def test_contaminated_rows_go_by_their_own_text(spark, slice_chars):
    docs, items = contamination_rows(6)
    ids = [None if k % 3 == 0 else 5 for k in range(len(docs))]
    df = spark.createDataFrame([(i, t, 1) for i, (_, t) in zip(ids, docs)], "doc_id long, text string, n_hit int")
    left = decontam.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"), slice_chars=slice_chars)
    each = slow_contamination(list(enumerate(t for _, t in docs)), items)
    assert sorted(map(str, left.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i!r}, text={t!r})" for k, (i, (_, t)) in enumerate(zip(ids, docs)) if not each[k][1])


# language-model scores


def test_scores_equal_a_plain_model(spark):
    rows = [(1, "a b a b a c"), (2, "b a B a"), (3, "c c c d"), (4, None), (5, " "), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("loss_target", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (3, 0), (1, 1), (None, 1), (77, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in lmscore.score_documents(docs, labels).collect()}
    wb, pb = lmscore.table_bits(0)
    tables = []
    for keep in ({1, 2, 3, None}, {1}):
        first, word, pair = Counter(), Counter(), Counter()
        for i, t in rows:
            if i in keep:
                for w, u, p in zip(*lmscore.slots(lmscore.word_ids((t or "").encode()), wb, pb)):
                    first[u] += 1
                    word[w] += 1
                    pair[p] += 1
        tables.append((keep, first, word, pair))
    for i, t in rows:
        if not (t or "").split():
            assert (got[i].n_tokens, got[i].ce_diff) == (0, None)
            continue
        means = []
        for keep, *seen in tables:
            first, word, pair = map(Counter, seen)
            for w, u, p in zip(*lmscore.slots(lmscore.word_ids(t.encode()), wb, pb)) if i in keep else ():
                first[u] -= 1  # a model has not seen the text that it scores
                word[w] -= 1
                pair[p] -= 1
            n, loss = sum(word.values()), []
            for w, u, p in zip(*lmscore.slots(lmscore.word_ids(t.encode()), wb, pb)):
                one = (word[w] + lmscore.ALPHA) / (n + lmscore.ALPHA * 2**wb)
                two = pair[p] / first[u] if first[u] else 0
                loss.append(-math.log((1 - lmscore.MIX) * one + lmscore.MIX * min(two, 1)))
            means.append(np.mean(loss))
        assert got[i].ce_diff == pytest.approx(means[1] - means[0])
    copies = docs.unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(4).cast("long")))
    both = {r.doc_id: r for r in lmscore.score_documents(copies.where("text is not null"), labels).collect()}
    assert both[3].loss_background == both[4].loss_background < got[3].loss_background
    assert lmscore.score_documents(docs.limit(0), labels).count() == 0
    assert lmscore.score_documents(docs, labels.limit(0)).count() == len(rows)


def test_distinct_pairs_never_share_counts(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "CHUNK_CHARS", 60_000, raising=False)
    monkeypatch.setattr(lmscore, "SLICE_CHARS", 90_000, raising=False)
    rnd = random.Random(3)
    rows = [(k if k % 9 else None, " ".join(f"w{rnd.randint(0, 299)}" for _ in range(1000))) for k in range(60)] + [(7, "w1 w2"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(k, k % 3 == 0) for k in range(60)], "doc_id long, quality boolean")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ce_diff or 0) for r in lmscore.score_documents(docs, labels, target="quality").collect())
    wb, _ = lmscore.table_bits(sum(len(t or "") for _, t in rows))
    entries = [[0, *lmscore.slots(lmscore.word_ids((t or "").encode()), wb, 2 * wb)[0].tolist()] for _, t in rows]
    means = []
    for keep in (lambda i: True, lambda i: i is not None and i % 3 == 0):
        first, word, pair = Counter(), Counter(), Counter()
        for (i, _), e in zip(rows, entries):
            if keep(i):
                first.update(e[:-1])
                word.update(e[1:])
                pair.update(zip(e, e[1:]))
        loss = []
        for (i, _), e in zip(rows, entries):
            o1, o2, o3 = (Counter(x) if keep(i) else Counter() for x in (e[:-1], e[1:], zip(e, e[1:])))
            n = sum(word.values()) - sum(o2.values()) + lmscore.ALPHA * 2**wb
            each = [-math.log((1 - lmscore.MIX) * (word[w] - o2[w] + lmscore.ALPHA) / n + lmscore.MIX * ((pair[u, w] - o3[u, w]) / (first[u] - o1[u]) if first[u] > o1[u] else 0)) for u, w in zip(e, e[1:])]
            loss.append(np.mean(each or [0]))
        means.append(loss)
    want = sorted((i or -1, len(e) - 1, b - a) for (i, _), e, a, b in zip(rows, entries, *means))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-12)


def test_the_vocabulary_grows_with_the_corpus():
    bits = [lmscore.table_bits(n)[0] for n in (10**8, 10**9, 3 * 10**10, 10**11)]
    assert bits == sorted(set(bits)) and bits[2] >= 26


# personal data


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_base(text):
    def digits(x):
        return sum("0" <= c <= "9" for c in x)

    ok = {
        "email": lambda x: True,
        "ip": lambda x: all(int(p) <= 255 for p in x.split(".")),
        "card": lambda x: 16 <= digits(x) <= 19 and pii.luhn(re.sub("[ -]", "", x)),
        "phone": lambda x: 8 <= digits(x) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok[k](m[0])] for k, p in PLAIN.items()}


def test_base_matches_equal_the_patterns(spark):
    rnd = random.Random(2)
    bits = ["a@b.c", "x.y+z@mail.example.com", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (202) 555-0100", "+", ".", "-", " ", "  ", "9", "é", "\n", "007", "a.b@c", "5555555555554444", "1.2.3.4.5"]
    for _ in range(3000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 8)))
        assert pii.base_matches(t) == slow_base(t), t
    for r in read(spark, "documents", BIG).limit(400).collect():
        assert pii.base_matches(r.text) == slow_base(r.text)


def test_long_runs_stay_linear():
    for t in ("7" * 300_000, "a" * 300_000 + "@", "+1" + "(" * 300_000, "1." * 150_000, "@" * 200_000):
        pii.find_all(t, pii.SemiCRF({}))


def test_crf_learns_and_adds_what_patterns_miss():
    rnd = random.Random(4)
    texts = []
    for _ in range(150):
        n = "".join(rnd.choice("0123456789") for _ in range(4))
        texts += [f"call +1 (202) 555-{n} now", f"mail bob{n}@mail.example.com please", f"host 10.0.{rnd.randint(0, 255)}.{rnd.randint(0, 255)} is up", f"token = \"{n}ab{n}cd\" and page {n}"]
    crf = pii.fit_crf(texts)
    for t in texts[:40]:
        base, full = pii.find_all(t, crf)
        assert all(set(base[k]) <= set(full[k]) for k in pii.KINDS)
        spans = sorted(x for v in full.values() for x in v)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    for t, kind, span in (
        ("write to ann (at) mail (dot) example.com today", "email", "ann (at) mail (dot) example.com"),
        ("ann at mail dot com", "email", "ann at mail dot com"),
        ("reach ANN (AT) mail (DOT) com soon", "email", "ANN (AT) mail (DOT) com"),
        ("the host 10[.]0[.]0[.]1 is up", "ip", "10[.]0[.]0[.]1"),
        ("pay with 4111/1111/1111/1111 please", "card", "4111/1111/1111/1111"),
        ("call 030/1234567 now", "phone", "030/1234567"),
    ):
        base, full = pii.find_all(t, crf)
        assert not any(base.values()) and {k: [t[s:e] for s, e in v] for k, v in full.items() if v} == {kind: [span]}
    for t in ("nothing here", "on 2024-10-12 10:30:00 we met at noon", "card 4111/1111/1111/1112", "version 1.2.33.4567", "he stood at the door. Then"):
        assert pii.find_all(t, crf)[1] == {k: [] for k in pii.KINDS}, t


def test_added_spans_have_recall_and_precision(spark):
    """On examples written with another seed than those learned, and on the documents."""
    docs = [r.text for r in read(spark, "documents", BIG).collect()]
    crf = pii.train(read(spark, "documents", BIG))
    right, added, wanted = Counter(), Counter(), Counter()
    for t, true in pii.examples(docs[:100], 100, 4321):
        base, full = pii.find_all(t, crf)
        known = {x for k in pii.KINDS for x in base[k]}
        got = {(k, *x) for k in pii.KINDS for x in full[k] if x not in base[k]}
        want = {x for x in true if x[1:] not in known}
        for k, *_ in got:
            added[k] += 1
        for k, *_ in want:
            wanted[k] += 1
        for k, *_ in got & want:
            right[k] += 1
    for k, least in zip(pii.KINDS, (0.7, 0.95, 0.95, 0.9)):
        assert right[k] >= least * wanted[k] and right[k] >= least * added[k], (k, right, added, wanted)
    odd = 0
    for t in docs:
        base, full = pii.find_all(t, crf)
        odd += sum(len(full[k]) - len(base[k]) for k in pii.KINDS)
    assert odd < len(docs) / 50


def all_segmentations(n, cands):
    """Every set of candidates that don't overlap, as lists of their numbers."""
    if n == 0:
        return [[]]
    out = all_segmentations(n - 1, cands)
    for c, (i, j, _) in enumerate(cands):
        if j == n:
            out = out + [[*x, c] for x in all_segmentations(i, cands)]
    return out


def test_decoding_and_sums_equal_enumeration():
    rnd = random.Random(8)
    for _ in range(60):
        text = "".join(rnd.choice(["1.2.3.4", " 0301234567", "4111 1111 1111 1111", "a at b dot de", " ", "x", ".", "+49"]) for _ in range(4))
        weights = {}

        class Random(pii.SemiCRF):
            def score(self, kind, t, s, e):
                return weights.setdefault((kind, s, e), rnd.uniform(-2, 2))

        for tokens in pii.regions(text):
            tokens = tokens[:14]
            cands = pii.candidates(text, tokens)
            crf = Random({})
            v = [crf.score(k, text, tokens[i][0], tokens[j - 1][1]) for i, j, k in cands]
            every = all_segmentations(len(tokens), cands)
            got = crf.decode(text, tokens, [])
            assert sum(crf.score(k, text, s, e) for k, s, e in got) == pytest.approx(max(sum(v[c] for c in x) for x in every))
            total = sum(math.exp(sum(v[c] for c in x)) for x in every)
            log, share = pii.sums(len(tokens), cands, v)
            assert log == pytest.approx(math.log(total))
            for c in range(len(cands)):
                assert share[c] == pytest.approx(sum(math.exp(sum(v[d] for d in x)) for x in every if c in x) / total)


def test_pii_query(spark):
    got = QUERIES["op7_pii"](spark, SF).collect()
    rows = {r.doc_id: r.text for r in read(spark, "documents").collect()}
    assert len(got) == len(rows)
    for r in got:
        base = slow_base(rows[r.doc_id])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]
        assert {f"{k}:{s}:{e}" for k, v in base.items() for s, e in v} <= set(r.spans.split(","))
    odd = spark.createDataFrame([(None, "a@b.cd"), (1, None), (1, ""), (2, "a@b.cd"), (2, "a@b.cd")], "doc_id long, text string").withColumn("spans", F.lit(0))
    assert sorted(r.n_email for r in pii.find_pii(odd).collect()) == [0, 0, 1, 1, 1]
    assert pii.find_pii(odd.limit(0)).count() == 0


# mixing


def test_rake_meets_targets_and_budget():
    rnd = np.random.default_rng(0)
    cells = [(a, b) for a in "xyz" for b in "pq"]
    totals = rnd.uniform(10, 100, 6)
    goals = [{"x": 1, "y": 1, "z": 2}, {"p": 3, "q": 1}]
    w = mixing.rake(cells, totals, goals, 60)
    for d, g in enumerate(goals):
        for v, share in g.items():
            assert sum(x for c, x in zip(cells, w) if c[d] == v) == pytest.approx(totals.sum() * share / sum(g.values()))
    p = mixing.probabilities(totals, w, 0.5 * totals.sum())
    assert (p <= 1).all() and (p * totals).sum() == pytest.approx(0.5 * totals.sum())


def test_mix_rows_and_edge_cases(spark):
    rows = [(k, "alpha beta " * (k % 5), None if k % 7 == 0 else f"s{k % 3}", "en") for k in range(200)] + [(None, None, "s1", None), (3, "x", "s1", "en"), (3, "x", "s1", "en")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, source string, lang string, weight string")
    out = mixing.mix(df)
    assert out.count() == len(rows) and len(set(out.columns)) == len(out.columns)
    a, b = sorted(map(str, out.collect())), sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    assert a == b
    e = out.agg(F.sum(F.col("n_tokens") * F.col("probability")), F.sum("n_tokens")).first()
    assert e[0] == pytest.approx(e[1] / 2)
    assert out.where("doc_id = 3 and text = 'x'").select("sampled").distinct().count() == 1
    assert mixing.mix(df.limit(0)).count() == 0
    only = mixing.mix(df, targets={"source": {"s1": 1.0}})
    assert {r.source for r in only.where("probability > 0").collect()} == {"s1"}


# chats


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|im_end|>", "\\", "\\\\", "<|", "<\\|", "<\\\\|", "a\nb", "", "<|im_start|>user\nhi<|im_end|>\n", "<", "|", "\\n", "x\\"]
    rnd = random.Random(0)
    rows, want = [], {}
    for c in range(60):
        for t in range(rnd.randint(1, 5)):
            role, text = rnd.choice(["user", "assistant", "sys\\n\ntem<|", ""]), "".join(rnd.choice(nasty) for _ in range(rnd.randint(0, 4)))
            rows.append((c, t, role, text))
            want.setdefault(c, []).append((role, text))
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("segments", F.lit(1))
    out = chat.read_back(chat.format_chats(df)).collect()
    for r in out:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.loss_text == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.formatted.count("<|im_end|>") == len(want[r.conv_id])


@pytest.mark.parametrize(("roles", "bad"), [("ua", None), ("sua", None), ("su", 2), ("uu", 1), ("a", 0), ("uas", 2), ("uaua", None), ("x", 0)])
def test_turn_order(spark, roles, bad):
    names = {"u": "user", "a": "assistant", "s": "system", "x": None}
    df = spark.createDataFrame([(1, k, names[c], "t") for k, c in enumerate(roles)], "conv_id long, turn int, role string, text string")
    r = chat.format_chats(df).first()
    assert (r.valid, r.bad_at) == (bad is None, bad)


def test_chat_edge_cases(spark):
    df = spark.createDataFrame([(None, 0, "user", None), (1, None, "user", "a"), (1, 0, "assistant", "b"), (1, 0, "assistant", "b")], "conv_id long, turn int, role string, text string")
    got = {r.conv_id: (r.n_turns, [t.text for t in r.turns]) for r in chat.read_back(chat.format_chats(df)).collect()}
    assert got == {None: (1, [""]), 1: (3, ["a", "b", "b"])}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_runs_no_python(spark):
    plan = QUERIES["op8_chat_format"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# quality and toxicity


def test_em_finds_the_accuracies():
    rnd = random.Random(1)
    counts = Counter()
    for _ in range(20_000):
        good = rnd.random() < 0.8
        votes = [(-1 if rnd.random() < 0.2 else int(good if rnd.random() < acc else not good)) for acc in (0.95, 0.9, 0.9, 0.85)]
        counts[quality.pattern(votes)] += 1
    share, table, _ = quality.fit_labellers(counts, 4)
    assert share == pytest.approx(0.8, abs=0.03)
    assert [table[j, 1, 2] for j in range(4)] == pytest.approx([0.95, 0.9, 0.9, 0.85], abs=0.03)


def slow_em(votes, rounds):
    """Dawid and Skene over single documents: P(good) of each, by plain loops."""
    k = len(votes[0])
    q = [0.1 if 0 in v else 0.95 for v in votes]
    for _ in range(rounds):
        share = sum(q) / len(q)
        says = [[[1.0, 1.0] for _ in (0, 1)] for _ in range(k)]
        for v, p in zip(votes, q):
            for j, x in enumerate(v):
                if x >= 0:
                    says[j][0][x] += 1 - p
                    says[j][1][x] += p
        new = []
        for v in votes:
            like = [1 - share, share]
            for c in (0, 1):
                for j, x in enumerate(v):
                    if x >= 0:
                        like[c] *= says[j][c][x] / sum(says[j][c])
            new.append(like[1] / sum(like))
        q = new
    return q


def slow_linear(feats, q):
    """Logistic regression by Adagrad on dicts of features, the last weight the bias."""
    good, bad = max(sum(q), 1), max(len(q) - sum(q), 1)
    each = [p / good + (1 - p) / bad for p in q]
    w, g2, whole = Counter(), {}, sum(each)
    for _ in range(quality.EPOCHS):
        g = Counter({k: 1e-5 * v for k, v in w.items() if k != "bias"})
        for f, p, a in zip(feats, q, each):
            z = w["bias"] + sum(w[k] * v for k, v in f.items())
            err = (1 / (1 + math.exp(-max(-30, min(30, z)))) - p) * a / whole
            g["bias"] += err
            for k, v in f.items():
                g[k] += v * err
        for k, v in g.items():
            g2[k] = g2.get(k, 1e-8) + v * v
            w[k] -= 0.5 * v / math.sqrt(g2[k])
    return w


def test_quality_equals_plain_em_and_scorer(spark):
    rows = read(spark, "documents").collect()
    made = {r.doc_id: quality.describe(r.text.encode()) for r in rows if r.text.split()}
    q = dict(zip(made, slow_em([v for v, _ in made.values()], quality.EM_ROUNDS)))
    w = slow_linear([f for _, f in made.values()], list(q.values()))
    for r in quality.score_quality(read(spark, "documents")).collect():
        assert r.weak_good == pytest.approx(q[r.doc_id], abs=1e-6)
        z = w["bias"] + sum(w[k] * v for k, v in made[r.doc_id][1].items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3) and r.keep == (r.score >= 0.5)


def test_votes_of_plain_texts():
    name = lambda t: dict(zip(quality.LABELLERS, quality.describe(t.encode())[0]))
    good = name("The cat of the house is on the mat, and it was good for us. We like to be with it in the sun.")
    assert set(good.values()) <= {1, -1} and good["function_words"] == good["symbols"] == 1
    bad = name("|||| BUY NOW!!! BUY NOW!!! $$$ %%% &&& BUY NOW!!! BUY BUY BUY BUY ####")
    assert bad["symbols"] == bad["capitals"] == bad["shouting"] == 0
    assert quality.describe(b" \n") is None


def test_quality_agrees_with_held_labels(spark):
    got = quality.score_quality(read(spark, "documents", BIG)).join(read(spark, "labels", BIG), "doc_id").collect()
    right = sum(r.keep == (r.quality == 1) for r in got) / len(got)
    clean = [r.keep for r in got if r.quality == 1]
    assert right > 0.97 and sum(clean) / len(clean) > 0.98


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (None, "the cat of the house is on the mat, and it was good."), (3, "a"), (3, "a"), (4, "word " * 200_000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = quality.score_quality(df).collect()
    assert len(got) == 6 and all(not r.keep and r.score == 0 for r in got if r.doc_id in (1, 2))
    assert quality.score_quality(df.limit(0)).count() == 0
    assert quality.keep_good(df.limit(0)).columns == df.columns


def test_toxicity_on_held_out_rows(spark):
    docs, labels = read(spark, "documents", BIG), read(spark, "labels", BIG)
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_toxicity_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (None, "idiot"), (2, ""), (2, ""), (3, "x " * 300_000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.score, 6) for r in toxicity.score_toxicity(df, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(df, odd).count() == 5
    assert toxicity.score_toxicity(df.limit(0), odd).count() == 0


def slow_tree(x, g, h, rows, depth, cuts):
    """The best cut at each level by plain loops: ("leaf", value) or (feature, cut, low, high)."""
    gs, hs = sum(g[r] for r in rows), sum(h[r] for r in rows)
    best, pick = 1e-3, None
    if depth and len(rows) >= 20:
        for j, cs in enumerate(cuts):
            for c in cs:
                low = [r for r in rows if x[r][j] < c]
                gl, hl = sum(g[r] for r in low), sum(h[r] for r in low)
                if hl >= 1 and hs - hl >= 1:
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    if gain > best + 1e-9:
                        best, pick = gain, (j, c)
    if pick is None:
        return ("leaf", -gs / (hs + 1))
    j, c = pick
    return (j, c, slow_tree(x, g, h, [r for r in rows if x[r][j] < c], depth - 1, cuts), slow_tree(x, g, h, [r for r in rows if x[r][j] >= c], depth - 1, cuts))


def test_boosting_equals_plain_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3)).round(2)
    y = ((x[:, 0] > 0.2) | (x[:, 2] < -0.7)).astype(float)
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, toxicity.BINS + 1)[1:-1]))) for j in range(3)]
    z = [math.log(y.mean() / (1 - y.mean()))] * len(x)
    for _ in range(6):
        p = [1 / (1 + math.exp(-v)) for v in z]
        tree = slow_tree(x.tolist(), [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], list(range(len(x))), toxicity.DEPTH, cuts)
        for r in range(len(x)):
            t = tree
            while t[0] != "leaf":
                t = t[2] if x[r][t[0]] < t[1] else t[3]
            z[r] += toxicity.RATE * t[1]
    assert toxicity.Boosted(6).fit(x, y).raw(x) == pytest.approx(z)


def test_lexicons_equal_counts_of_each_fold():
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["idiot", "1d1ot", "idiots", "nice", "day", "the", "moronic"]) if rnd.random() < 0.5 else rnd.choice(["the", "day", "nice"]) for _ in range(8)) for _ in range(90)]
    toxic = np.array([float("idiot" in t or "moron" in t) for t in texts])
    fold = np.arange(len(texts)) % 3
    for f, lex in zip((0, 1, 2, None), toxicity.lexicons(texts, toxic, fold)):
        use = [k for k in range(len(texts)) if f is None or fold[k] != f]
        sets = {k: {x for w in texts[k].translate(toxicity.PLAIN).split() for x in toxicity._terms(w)} for k in use}
        n1 = sum(toxic[k] for k in use)
        want = {}
        for t in set().union(*sets.values()):
            pos, neg = (sum(t in sets[k] for k in use if toxic[k] == v) for v in (1, 0))
            odds = math.log((pos + 0.5) / (n1 + 1)) - math.log((neg + 0.5) / (len(use) - n1 + 1))
            if pos >= toxicity.MIN_DOCS and odds > 2.5:
                want[t] = odds
        assert lex == pytest.approx(want)


def test_toxicity_rows_equal_a_plain_run(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    text = {r.doc_id: r.text for r in docs.collect()}
    use = sorted((r.doc_id, r.toxic) for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in text)
    model = toxicity.fit_toxicity([text[i] for i, _ in use], [y for _, y in use])
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got == pytest.approx({i: float(model.scores([t])[0]) for i, t in text.items()})


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    z = toxicity.Boosted(60).fit(x[:1500], y[:1500]).raw(x[1500:])
    assert ((z > 0) == (y[1500:] == 1)).mean() > 0.95
    knots, values = toxicity.isotonic(np.arange(100.0), (np.arange(100) >= 50).astype(float))
    assert (np.diff(values) >= 0).all() and values[0] < 0.1 and values[-1] > 0.9
    assert len(knots) == len(values)

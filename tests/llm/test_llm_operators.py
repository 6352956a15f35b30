"""Operators against brute force, known answers and held-out data, on small fixtures."""

import collections
import hashlib
import itertools
import math
import time
import random
import re
import sys
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import util  # noqa: E402

import corpus_pipeline  # noqa: E402
from sluice.llm import fingerprint, html_text, jaccard_join, licenses, line_dedup, mixing, pieces, pii, quality, suffix_tree  # noqa: E402

SF = "/root/testdata/sf0.001"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


# PII


def test_pii_spans(spark):
    texts = [
        "mail a.b@x-y.example.com or c@d", "ip 1.2.3.4 and 1.2.3.256 and 001.2.3.4.5", "card 4539 1488 0343 6467 not 4539 1488 0343 6468", "call +1 (212) 555-0100, not +1 23",
        "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433", "é🙂 x@y.zz", "a@b.c_d@e.f",
    ]
    got = [[(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.pii] for r in pii.find_pii(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [
        [("email", "a.b@x-y.example.com")], [("ip", "1.2.3.4"), ("ip", "001.2.3.4")], [("card", "4539 1488 0343 6467")], [("phone", "+1 (212) 555-0100")],
        [("iban", "GB82 WEST 1234 5698 7654 32")], [("email", "x@y.zz")], [("email", "a@b.c"), ("email", "_d@e.f")],
    ]


def test_pii_context_and_redaction(spark):
    rows = pii.redact(pii.find_pii(docs_of(spark, ["see 10.0.0.1", "host 10.0.0.1, mail q@r.st"]))).orderBy("doc_id").collect()
    assert [s.score for r in rows for s in r.pii if s.kind == "ip"] == [0.6, 0.8]
    assert [r.redacted for r in rows] == ["see <IP>", "host <IP>, mail <EMAIL>"]


def test_ibans_end_with_their_country_and_context_stands_on_both_sides(spark):
    texts = ["IBAN ES91 2100 0418 4502 0005 1332 BIC CAIXESBB", "ES9121000418450200051332 is the account", "DE89370400440532013000x", "ES91 2100 0418 4502 0005 1332"]
    rows = pii.find_pii(docs_of(spark, texts)).orderBy("doc_id").collect()
    got = [[(s.kind, texts[r.doc_id][s.start : s.end], round(s.score, 1)) for s in r.pii] for r in rows]
    iban = "ES91 2100 0418 4502 0005 1332"
    assert got == [[("iban", iban, 0.8)], [("iban", iban.replace(" ", ""), 0.8)], [], [("iban", iban, 0.6)]]


# Language model


def test_base_scores_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = suffix_tree.op2_lm_score(spark, SF).collect()
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for i in train for w in words[i])
    count[None] = len(train)
    n, v = sum(count.values()), len(count)
    for r in rows:
        tokens = [*words[r.doc_id], None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.n_known == sum(count[w] > 0 for w in tokens)
        assert (r.n_tokens, r.train_tokens, r.held_out) == (len(tokens), n, r.doc_id not in train)


def _tree_of(texts, depth=4):
    keys, counts = np.unique(suffix_tree.grams(texts, depth)[0], return_counts=True)
    low, inv = np.unique(keys & np.uint64(0xFFFFFF), return_inverse=True)
    return suffix_tree.grow(keys, counts, suffix_tree.grow_head(low, np.bincount(inv, counts)), depth)


def test_distributions_are_proper():
    tree = _tree_of(["the cat sat on the mat", "the cat ran", None, "a dog"] * 5)
    assert len(tree.contexts[1]) > 0 and len(tree.contexts[4]) > 0
    for before in (0, 0x20746865, 0x7A7A7A7A, int(tree.contexts[1][0]), int(tree.contexts[4][0])):
        all_next = (np.uint64(before) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** tree.score(all_next)).sum() == pytest.approx(1.0, abs=1e-9)


def test_grams_of_texts_by_bytes():
    texts = ["Ab  c", None, "", "\n x", "é\tZ"]
    g, starts = suffix_tree.grams(texts, 6)
    want = []
    for t in texts:
        raw = b"\n" * 6 + b" ".join((t or "").encode().lower().split()) + b"\n"
        want.append([int.from_bytes(raw[i - 6 : i + 1], "big") for i in range(6, len(raw))])
    assert [x.tolist() for x in np.split(g, starts[1:])] == want


def _brute_scores(docs, depth, least):
    """Every context of every training text in one dictionary; states by the test, and whatever a longer state needs."""
    seqs = {i: b" ".join((t or "").encode().lower().split()) + b"\n" for i, t in docs}
    train = [i for i in seqs if zlib.crc32(str(i).encode()) % 10]
    count = collections.defaultdict(collections.Counter)
    for i in train:
        raw = b"\n" * depth + seqs[i]
        for at in range(depth, len(raw)):
            for k in range(depth + 1):
                count[raw[at - k : at]][raw[at]] += 1

    def p(ctx, x):
        c = count[ctx]
        n, kinds = sum(c.values()), len(c)
        if not ctx:
            return (c[x] + 1 / 256) / (n + 1)
        return (c[x] + kinds * p(ctx[1:], x)) / (n + kinds)

    states = {c for c in count if len(c) <= 2}
    for c in [c for c in count if len(c) > 2]:
        n = sum(count[c].values())
        gain = 2 * sum(m * math.log(m / n / p(c[1:], x)) for x, m in count[c].items())
        if n >= least and gain > len(count[c]) * math.log(n):
            states |= {c[j:] for j in range(len(c))}
    out = {}
    for i, seq in seqs.items():
        raw, total = b"\n" * depth + seq, 0.0
        for at in range(depth, len(raw)):
            ctx = next(raw[at - k : at] for k in range(depth, -1, -1) if raw[at - k : at] in states or not k)
            total += math.log10(p(ctx, raw[at]))
        out[i] = total
    return out


@pytest.mark.parametrize(("depth", "least", "chunk"), [(6, 2, 8_000_000), (4, 3, 900)])
def test_scores_by_brute_force(spark, monkeypatch, depth, least, chunk):
    """One chunk or many: chunks of texts and parts of the tree change no score."""
    monkeypatch.setattr(suffix_tree, "CHUNK", chunk)
    rng = random.Random(8)
    words = ["the", "cat", "sat", "mat", "on", "hats", "Éa", "ran", "x1"]
    docs = [(i, None if i % 17 == 3 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(120)] + [(500 + i, "a passage that repeats word for word in many documents") for i in range(9)]
    want = _brute_scores(docs, depth, least)
    got = {r.doc_id: r.score for r in suffix_tree.lm_scores(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), depth, least).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-5, abs=1e-4) for i in want)


def test_the_tree_grows_with_the_corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(50)) for _ in range(160)]
    sizes = [sum(map(len, _tree_of(texts[:n], 6).contexts[3:])) for n in (40, 80, 160)]
    assert sizes[0] * 1.5 < sizes[1] and sizes[1] * 1.5 < sizes[2]


def test_model_beats_base_on_held_out(spark):
    rows = [r for r in suffix_tree.op2_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


# Quality


def test_features_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = docs_of(spark, ["a b c d e a b c d e", "x\nx\n \n\nx", "#a $b", " ", None, "a a a a a a a"], 10_000)
    for r in docs.union(odd).select("text", quality.features(F.col("text")).alias("q")).collect():
        t, q = r.text or "", r.q
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (q.n_words, q.word_chars, q.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert (q.n_symbols, q.n_dup_lines) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))


def test_learned_list_rejects_bad_and_keeps_good(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    # Learned on two thirds of the labels, judged on the rest.
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id")
    rules = quality.learn(docs, labels.where("doc_id % 3 > 0").select("doc_id", "quality"))
    rest = docs.join(labels.where("doc_id % 3 = 0"), "doc_id").select("quality", quality.judged(F.col("text"), rules).alias("j")).select("quality", "j.kept", "j.base_failed")
    n = {(r.quality, r.kept, r.base_failed): r["count"] for r in rest.groupBy("quality", "kept", "base_failed").count().collect()}
    assert n.get((1, False, False), 0) == 0
    assert n.get((0, True, False), 0) <= 0.1 * sum(c for k, c in n.items() if k[0] == 0)


def test_no_labels_no_rules(spark):
    docs = docs_of(spark, ["a b c d e f g h i j k"])
    assert quality.learn(docs, spark.createDataFrame([], "doc_id bigint, quality int")) == []


def test_learned_list_by_brute_force(spark):
    """The emitted conditional against rules evaluated in Python, the rules' cover and order against the labelled rows, the first condition against many others."""
    rng = random.Random(12)
    rows = []
    for i in range(900):
        kind = rng.choice(["clean", "clean", "clean", "symbols", "shout"])
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(rng.randrange(15, 50))]
        if kind == "symbols":
            words = [w + "#$%" for w in words]
        if kind == "shout":
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(kind == "clean")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int").cache()
    rules = quality.learn(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    assert 1 <= len(rules) <= quality.MAX_RULES
    names = list(quality.SHARES)
    judged = docs.select("doc_id", "quality", quality.judged(F.col("text"), rules).alias("j"))
    got = judged.select("doc_id", "quality", "j.rule", "j.kept", "j.base_failed", *(quality.SHARES[n](F.col("j.q")).alias(n) for n in names)).collect()
    meets = lambda r, c: r[c.share] >= c.threshold if c.at_least else r[c.share] < c.threshold
    fired = lambda r: next((n for n, x in enumerate(rules, 1) if all(meets(r, c) for c in x.conditions)), 0)
    assert all(r.rule == fired(r) and r.kept == (not r.base_failed and r.rule == 0) for r in got)
    assert [x.covered for x in rules] == [sum(r.rule == n for r in got) for n in range(1, len(rules) + 1)]
    assert all(sum(1 - r.quality for r in got if r.rule == n) >= 0.9 * x.covered for n, x in enumerate(rules, 1))
    assert sum(r.kept == bool(r.quality) for r in got) > 0.97 * len(got)
    parts = {r.doc_id: r.p for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("p")).collect()}
    grow = [r for r in got if parts[r.doc_id] > 0]
    bad = sum(1 - r.quality for r in grow)

    def gain(c):
        p, n = (sum(meets(r, c) and r.quality == q for r in grow) for q in (0, 1))
        return p * (p / (p + n) - bad / len(grow)) if p else 0.0

    best = max(gain(quality.Condition(n, up, r[n])) for n in names for up in (True, False) for r in rng.sample(grow, 60))
    assert gain(rules[0].conditions[0]) >= 0.9 * best


# Licences


def test_whole_licences(spark):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and "granted" in t)
    texts = ["Copyright (c) 2020 Someone\n" + mit.upper(), "# " + mit.replace("License", "Licence").replace("\n", "\n#  "), mit + " No.", "text\n\nAll rights reserved.\nmore\nLicenced under the Apache Licence, version 2", "All Rights Reserved"]
    rows = licenses.scan_licenses(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r.license for r in rows] == ["MIT", "MIT", None, None, "all-rights-reserved"]
    assert rows[3].notices == "Apache-2.0,all-rights-reserved"


def test_whole_texts_and_runs_of_blocks(spark):
    bsd = dict(licenses.WHOLE)["BSD-3-Clause"]
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and "granted" in t)
    apache = open("/usr/share/common-licenses/Apache-2.0").read()
    texts = [bsd, "Copyright (c) 2020 A\n\n" + bsd, "Read me\n\n" + mit.replace("\n\n", "\n\nCopyright (c) 2020 B\n\n", 1) + "\n\nmore", "head\n\n" + apache + "\n\ntail", apache, "All rights\nreserved.", mit[: len(mit) // 2]]
    rows = licenses.scan_licenses(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r.license for r in rows] == ["BSD-3-Clause", "BSD-3-Clause", None, None, "Apache-2.0", "all-rights-reserved", None]
    assert [r.notices for r in rows] == ["BSD-3-Clause", "BSD-3-Clause", "MIT", "Apache-2.0", "Apache-2.0", "all-rights-reserved", ""]


def test_the_prefilter_follows_the_known_texts(spark):
    known = (("x", "Redistribution and use are fine."), ("y", "Nutzung frei\n\nfür alle"), ("z", "Sub-License while version 2.0"))
    rows = licenses.scan_licenses(docs_of(spark, ["a\nREDISTRIBUTION and use are fine\nb", "a\n\nNutzung frei\n\n für alle.\n\nb", "a\nsublicense whilst version 2\n"]), known=known).orderBy("doc_id").collect()
    assert [r.notices for r in rows] == ["x", "y", "z"]


# Mixing


def test_water_filling(spark):
    rows = [("d0", "en", "a", 100), ("d0", "en", "b", 1000), ("d0", "de", "c", 10), ("d1", None, "e", 50), ("d1", None, None, 50)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens bigint")
    got = {(r.domain, r.lang, r.source): r.target for r in mixing.leaf_targets(leaves, 600, {}, 1).collect()}
    # d1 can use 100 of its 300; the rest goes to d0: c holds 10, a 100 of its half, b the rest.
    assert got == {("d1", None, "e"): 50, ("d1", None, None): 50, ("d0", "de", "c"): 10, ("d0", "en", "a"): 100, ("d0", "en", "b"): 390}
    assert all(r.target == 0 for r in mixing.leaf_targets(leaves, 0, {}, 3).collect())
    weights = {"domain": {"d1": 0}}
    assert {r.target for r in mixing.leaf_targets(leaves, 200, weights, 1).where("domain = 'd1'").collect()} == {0}


def test_epochs_and_prefixes(spark):
    rows = [(i, "en" if i % 2 else None, "src1", " ".join(["w"] * (1 + i % 4))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string")
    units = mixing.units_of(docs)
    plan = mixing.mixing_plan(units, budget=700, weights={"lang": {"en": 1}})
    targets = {r.lang: r.target for r in plan.collect()}
    chosen = mixing.select_epochs(units, plan)
    for r in chosen.groupBy("lang").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("most")).collect():
        assert targets[r.lang] <= r.n < targets[r.lang] + r.most
    per = chosen.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("epoch").alias("e")).collect()
    assert all(r.n == r.e for r in per) and {r.n for r in per} <= {1, 2, 3}


def test_only_line_feeds_end_a_copyright_line(spark):
    texts = ["Copyright 2020 A\rB\u2028C\x85D\nMIT License", "MIT License"]
    df = docs_of(spark, texts).select(licenses.canonical(F.col("text")).alias("c"))
    assert [r.c for r in df.collect()] == ["mit license"] * 2


def test_budgets_are_spent_whole(spark):
    """Ten tokens over three equal leaves are four, three and three; caps and unequal weights leave nothing either."""

    def targets(leaves, budget, weights):
        df = spark.createDataFrame([("d0", "en", n, t) for n, t in leaves], "domain string, lang string, source string, tokens bigint")
        return {r.source: r.target for r in mixing.leaf_targets(df, budget, weights, 1).collect()}

    assert targets([("a", 100), ("b", 100), ("c", 100)], 10, {}) == {"a": 4, "b": 3, "c": 3}
    assert targets([("a", 2), ("b", 100), ("c", 100)], 11, {"source": {"b": 3}}) == {"a": 2, "b": 7, "c": 2}
    assert targets([("a", 2), ("b", 3)], 100, {}) == {"a": 2, "b": 3}
    assert targets([("a", 20), ("b", 30)], 7, {"source": {"a": 0}}) == {"a": 0, "b": 7}
    rng = random.Random(3)
    for _ in range(3):
        leaves = [(f"s{i}", rng.randrange(1, 60)) for i in range(7)]
        got = targets(leaves, 150, {"source": {f"s{i}": rng.randrange(1, 5) for i in range(7)}})
        assert sum(got.values()) == min(150, sum(t for _, t in leaves)) and all(got[n] <= t for n, t in leaves)


# Pieces


def _all_segmentations(v, t, theta):
    out = []

    def go(i, ids, w):
        if i == len(t):
            out.append((tuple(ids), w))
            return
        single = False
        for n in range(1, 17):
            p = t[i : i + n]
            k = v.sp.piece_to_id(p)
            if len(p) == n and k > 0 and v.sp.id_to_piece(k) == p and not v.sp.is_byte(k):
                single |= n == 1
                go(i + n, [*ids, k], w + theta * v.log_p[k])
        if not single:
            b = t[i].encode()
            go(i + 1, [*ids, *(int(v.byte_id[x]) for x in b)], w + theta * v.log_byte * len(b))

    go(0, [], 0.0)
    return out


def _samples(v, texts, seeds, k, theta):
    """(text, sample, ids, log p, inclusion), one by one."""
    for s, has, ids, n_ids, log_p, inclusion in pieces.sample_segmentations(v, texts, seeds, k, theta):
        for d, part, lp, w in zip(has.tolist(), np.split(ids, np.cumsum(n_ids)[:-1]) if len(n_ids) else [], log_p, inclusion, strict=True):
            yield d, s, part, float(lp), float(w)


def test_samples_follow_the_lattice():
    v, theta, n = pieces.vocabulary(pieces.MODEL), 0.6, 5000
    t = v.normalize("hat on")
    every = _all_segmentations(v, t, theta)
    z = math.log(sum(math.exp(w) for _, w in every))
    p = {ids: math.exp(w - z) for ids, w in every}
    seeds = np.array([pieces._seed(i) for i in range(n)], np.uint64)
    first, second, weight = collections.Counter(), collections.Counter(), collections.Counter()
    for d, s, ids, log_p, inclusion in _samples(v, [t] * n, seeds, 2, theta):
        assert math.exp(log_p) == pytest.approx(p[tuple(ids)], abs=1e-9)
        (first if s == 1 else second)[tuple(ids)] += 1
        weight[d] += math.exp(log_p) / inclusion
    assert max(abs(first[x] / n - q) for x, q in p.items()) < 0.03
    without = {x: sum(p[y] * p[x] / (1 - p[y]) for y in p if y != x) for x in p}
    assert max(abs(second[x] / n - q) for x, q in without.items()) < 0.03
    assert np.mean(list(weight.values())) == pytest.approx(1.0, abs=0.05)  # inclusion scores weigh samples without bias


def test_every_segmentation_once():
    v = pieces.vocabulary(pieces.MODEL)
    for text in ("at 中", "a\nb", "  x ", "\U0001f9ff"):
        t = v.normalize(text)
        got = [tuple(ids.tolist()) for _, _, ids, _, _ in _samples(v, [t], np.array([7], np.uint64), 500, 0.6)]
        assert len(got) == len(set(got)) and set(got) == {ids for ids, _ in _all_segmentations(v, t, 0.6)}
        assert {v.decode(ids) for ids in got} == {text}


def test_texts_of_one_call_do_not_touch_each_other():
    """Three samples each, texts with fewer, empty and bare ones: alone or together gives the same bits."""
    v = pieces.vocabulary(pieces.MODEL)
    texts = [v.normalize(t) for t in ("", "a", "hat on", "\U0001f9ff\U0001f9ff a", "a\nb\n\n c", "x" * 300, "hat hat hat")]
    seeds = np.array([pieces._seed(i) for i in range(len(texts))], np.uint64)
    together = {(d, s): (tuple(ids.tolist()), lp, w) for d, s, ids, lp, w in _samples(v, texts, seeds, 4, 0.6)}
    alone = {(i, s): (tuple(ids.tolist()), lp, w) for i, t in enumerate(texts) for _, s, ids, lp, w in _samples(v, [t], seeds[i : i + 1], 4, 0.6)}
    assert together == alone and len({x[0] for (d, _), x in together.items() if d == 2}) == 4
    for i, t in enumerate(texts):
        assert all(v.spells(np.array(x[0], np.int32), np.array([len(x[0])]), [t.encode()]).all() for (d, _), x in together.items() if d == i)


def test_units_are_those_of_the_pattern():
    texts = ["", "▁a▁▁b\n▁\n\nc", "▁▁", "a", "\n"]
    cps, per_text, begins, sizes = pieces._units(texts)
    all_ = "".join(texts)
    assert [all_[b : b + n] for b, n in zip(begins, sizes, strict=True)] == [u for t in texts for u in pieces._UNIT.findall(t)]
    assert per_text.tolist() == [len(pieces._UNIT.findall(t)) for t in texts] and len(cps) == len(all_)


def test_batches_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a, b = (sorted(tuple(r) for r in pieces.sampled_encodings(docs.repartition(n), with_ids=False).collect()) for n in (1, 5))
    assert a == b and all(r[-1] for r in a) and len(a) == 2 * docs.count()


def test_round_trips(spark):
    texts = [t for t in util.ODD if t is not None and "▁" not in t]
    rows = pieces.decoded(pieces.best_encoding(docs_of(spark, texts))).orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == texts
    v = pieces.vocabulary(pieces.MODEL)
    assert all(v.decode(v.sp.encode(t)) == v.sp.decode(v.sp.encode(t)) for t in texts if t != "x\n\n\ny\n")


# Line dedup


def test_runs_are_levelled_and_settled_keys_stay_out(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([("hot", 100 - 10 * b - i) for i in range(4)] + [(f"k{b}", 100 - 10 * b)], "key string, id bigint"))
    assert [len(p) for p in runs.levels] == [1, 0, 1]
    state = {r.key: (r.n_docs, r.max_id) for r in runs.state().collect()}
    assert state == {"hot": (4, 100)} | {f"k{b}": (1, 100 - 10 * b) for b in range(5)}


def test_the_largest_id_keeps_the_line(spark):
    line = "This line is long enough to be a candidate, surely."
    docs = docs_of(spark, [f"a{i}\n  {line.upper()}\t\nshort\n{line}" for i in range(5)] + ["short", None])
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert [rows[i].n_dropped for i in range(7)] == [2, 2, 2, 2, 0, 0, 0]
    assert rows[0].kept_text == "a0\nshort" and rows[6].kept_text == "" and rows[6].n_lines == 1


def test_runs_are_merged_without_an_exchange(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3)
    for b in range(3):
        runs.add(spark.createDataFrame([(f"k{i}", 10 * b + i) for i in range(9)], "key string, id bigint"))
    conf = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        own = spark.createDataFrame([("k1", 5, 7)], "key string, n_docs bigint, max_id bigint").repartition(runs.buckets, "key")
        plan = runs.unsettled(own)._jdf.queryExecution().executedPlan().toString()
        merged = runs.state()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", conf)
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Exchange" not in merged
    assert {r.key: (r.n_docs, r.max_id) for r in runs.state().collect()} == {f"k{i}": (3, 20 + i) for i in range(9)}
    runs.drop()


def test_lines_over_any_ids(spark):
    line = "This line is long enough to be a candidate, surely."
    ids = [-(2**63), -(2**62), 0, 2**62, 2**63 - 1, None, None]
    rows = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame([(i, line) for i in ids], "doc_id bigint, text string")).collect()}
    assert rows == {i: int(i != 2**63 - 1) for i in ids}
    assert line_dedup.batch_ranges(-(2**63), 2**63 - 1, 4)[0] == (2**62, 2**63 - 1)
    assert line_dedup.batch_ranges(5, 6, 4) == [(6, 6), (5, 5)]


# Fingerprints


def test_likeness_and_branches(spark):
    a = "First one. Second one.\nThird line here.\n\nAnother section. With two sentences."
    b = a.replace("Third", "3rd")
    df = spark.createDataFrame([(a, a, 1.0), (a, b, 0.8), (a, "", 0.0), ("", "", 1.0), ("é", "zz", 0.0)], "a string, b string, want double")
    prints = df.select("want", fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))).alias("got"))
    assert all(r.got == pytest.approx(r.want) for r in prints.collect())
    where = df.limit(2).select(fingerprint.differing_branches(fingerprint.merkle_tree(F.col("a")), fingerprint.merkle_tree(F.col("b"))).alias("d")).collect()
    assert [[tuple(x) for x in r.d] for r in where] == [[], [(0, 1, 0)]]


def test_next_in_order_over_sparse_ids(spark):
    rng = random.Random(5)
    ids = sorted({rng.randrange(10**rng.randrange(1, 12)) for _ in range(400)}, reverse=True)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(df, "doc_id", ["text"]).collect()}
    assert got == {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_next_over_any_ids(spark, monkeypatch):
    """Ids over the whole of bigint, nulls, and one id on most rows with few texts; stretches of a few rows."""
    monkeypatch.setattr(fingerprint, "STRETCH_ROWS", 7)
    rng = random.Random(6)
    rows = [(rng.randrange(-(2**63), 2**63), f"t{i}") for i in range(200)] + [(i, "edge") for i in (-(2**63), 2**63 - 1, 0, None, None)]
    rows += [(42, f"s{i % 9}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), digest(r[1])))
    want = collections.Counter((i, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order))
    got = collections.Counter((r.doc_id, r.text, r.next_text) for r in fingerprint.with_next(df, "doc_id", ["text"]).collect())
    assert got == want
    one = fingerprint.with_next(spark.createDataFrame([(None, "x")], "doc_id bigint, text string"), "doc_id", ["text"]).collect()
    assert [(r.text, r.next_text) for r in one] == [("x", "x")]


# Jaccard join


def _brute(texts, size=5, percent=75):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            up[b] = a
    return [(i, len(s), top(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_brute_force(spark, monkeypatch, seed):
    """Families of near copies, edited to either side of the threshold, around shared passages, with lists far over SHORT."""
    monkeypatch.setattr(jaccard_join, "SHORT", 4)
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    passage = [word() for _ in range(40)]
    texts = []
    for family in range(6):
        base = [word() for _ in range(60 + 30 * family)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w = passage + w
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), None, "", "one two", "ONE two", "one two three"] + [" ".join(passage + [word() for _ in range(12)]) for _ in range(30)]
    rng.shuffle(texts)
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs_of(spark, texts)).collect())
    assert got == _brute(texts)


def test_skipped_blocks_lose_no_pair():
    """All pairs of long lists by size, position and what the leader tells, with batches that cut a list."""
    rng, m = np.random.default_rng(1), 400
    for _ in range(3):
        token, n, comp = np.sort(rng.integers(0, 3, m)), rng.integers(20, 60, m), rng.integers(0, 20, m)
        key, pos = rng.permutation(5 * m)[:m], (rng.random(m) * n * 0.25).astype(int)
        near = np.where(rng.random(m) < 0.5, -1, (rng.random(m) * n).astype(int))
        o = np.lexsort((key, n, token))
        token, key, n, pos, comp, near = (x[o].astype(np.int64) for x in (token, key, n, pos, comp, near))
        want = set()
        for i in range(m):
            for j in range(i + 1, m):
                need = jaccard_join.overlap_needed(n[i], n[j])
                known = near[i] >= 0 and near[j] >= 0
                if (
                    token[i] == token[j] and comp[i] != comp[j] and 100 * n[i] >= 75 * n[j] and 1 + min(n[i] - pos[i], n[j] - pos[j]) - 1 >= need
                    and not (known and min(near[j] + n[i] - near[i], near[i] + n[j] - near[j]) < need)
                ):
                    want.add((max(key[i], key[j]), min(key[i], key[j])))
        rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (token, key, n, pos, comp, near)], ["token", "key", "n", "pos", "comp", "near"])
        got = set()
        for out in jaccard_join._pairs(True, None, 75)(iter([rows.slice(0, 40), rows.slice(40, 10), rows.slice(50, 100), rows.slice(150)])):
            got |= set(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
        assert got == want and len(want) > 100


def test_other_thresholds(spark):
    texts = ["a b c d", "a b c e", "a b c d e f", "x y z", "x y z"]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs_of(spark, texts), size=1, percent=60).collect())
    assert got == _brute(texts, 1, 60)


# HTML


PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body><header><a href="/">Site</a></header>
<nav class="menu"><ul><li><a href="/a">Home</a><li>More</ul></nav><div class="cookie-notice">We use cookies</div><div id="wrap"><{tag}><h1>Title {i}</h1>
<p>First <b>bold &lt;x&gt; &#233;&nbsp;
text<br>here.<p>Second {i}</p><!-- <p>hidden</p> --><div class="ad">Buy</div><ul><li>one<li>two</ul><form><input value="a>b"> Search</form><div class="comments"><p>Nice!</p></div></{tag}></div>
<aside>Side</aside><footer>&copy; 2020</footer></body>"""


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_extraction(spark, tag):
    pages = [(i, f"http://a.example.com/{i}", PAGE.format(i=i, tag=tag)) for i in range(6)] + [(6, "x", None), (7, "http://b.example.com", "just text"), (8, "http://c.example.com", "<p>cut <b"), (9, None, "")]
    rows = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert rows[3].text == "Title 3\nFirst bold <x> é text here.\nSecond 3\none\ntwo"
    assert [rows[i].text for i in (6, 7, 8, 9)] == ["", "just text", "cut <b", ""] and rows[3].n_chars == len(rows[3].text)


def test_article_of_real_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html_text.op10_html_text(spark, SF).collect():
        inside = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html_text.html_lib.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("icon", ["<svg-icon></svg-icon>", "<select-box></select-box>", "<title-bar></title-bar>", '<svg class="i" viewBox="0 0 1 1"/>', "<svg/>", "<svg><path d='M0'/></svg>", "<SCRIPT>x</SCRIPT >"])
def test_markup_ends_where_it_ends(icon):
    assert html_text.main_text(f"<article><p>before {icon}after</p><p>last</p></article>", set()) == "before after\nlast"


WRAPPERS = ["<body class='single-post no-sidebar'>{}</body>", "<div class='content has-sidebar'>{}</div>", "<div id='social-policy'>{}</div>", "<div class='sidebar-left'>{}</div>", "<form><div>{}</div></form>", "<main class='widget'>{}</main>"]


@pytest.mark.parametrize("wrapper", [*WRAPPERS, "<article class='post comments-open'>{}</article>"])
@pytest.mark.parametrize("inner", ["<p>one two three</p><p>four five six</p>", "<article><p>one two three</p><p>four five six</p></article>"])
def test_names_of_wrappers_drop_no_text(wrapper, inner):
    page = wrapper.format("<div class='comment-list'>Nice</div>" + inner + "<div id='siteFooter'>me</div>")
    assert html_text.main_text(page, set()) == "one two three\nfour five six"


def test_articles_spread_over_named_elements():
    page = "<nav>menu</nav>" + "".join(f"<div class='widget'><article><p>text {i}</p></article></div>" for i in range(3))
    assert html_text.main_text(page, set()) == "text 0\ntext 1\ntext 2"


def test_pages_without_article_keep_all_their_text(spark):
    long = "word " * 60
    pages = [("http://one.example.com/", f"<div id=c><h1>title</h1><p>{long}</p></div>", f"title\n{long.strip()}")]
    pages += [(f"http://two.example.com/{i}", f"<div id=c><div class=intro>intro {i} {long[:60]}</div><div class=text>text {i} {long[:180]}</div></div>", f"intro {i} {long[:60].strip()}\ntext {i} {long[:180].strip()}") for i in range(5)]
    pages += [(f"http://odd.example.com/{i}", f"<div id=c><div class=text>text {i} {long}</div></div>" + f"<div class=more>rest {i}</div>" * (i == 2), f"text {i} {long.strip()}" + f"\nrest {i}" * (i == 2)) for i in range(5)]
    pages += [(f"http://gap.example.com/{i}", "<article></article><p>only here</p>" if i == 2 else f"<article>text {i}</article>", "only here" if i == 2 else f"text {i}") for i in range(5)]
    rows = html_text.extract_text(spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {i: t for i, (_, _, t) in enumerate(pages)}


def _texts(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.example.com/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    return [r.text for r in html_text.extract_text(df).orderBy("page_id").collect()]


def test_what_all_pages_of_a_host_share_is_template(spark):
    """Without a name or tag that tells: text around the slot, and a teaser within the main element; and no name empties an article."""
    around = [f"<body><div class='x'><p>Same head</p></div><div class='y'><p>Own text {i} of its page</p></div><div class='z'><p>Same foot</p></div></body>" for i in range(8)]
    assert _texts(spark, around) == [f"Own text {i} of its page" for i in range(8)]
    teaser = [f"<body><main><h1>Title {i}</h1><p>Body {i}</p><div class='tease'><span>Read on</span><p>Ten best things</p></div></main></body>" for i in range(8)]
    assert _texts(spark, teaser) == [f"Title {i}\nBody {i}" for i in range(8)]
    assert _texts(spark, ["<article class='sponsored-by-none'><p>All of it</p></article>"] * 8) == ["All of it"] * 8


def test_templates_by_brute_force(spark):
    """On a small host: text under a path that stands equally often in all pages and never changes goes, the rest of the slot stays."""
    rng = random.Random(9)
    rows, want = [], []
    for i in range(6):
        parts = [("k" + "abcdefg"[j], j in (0, 3, 5)) for j in range(7)]
        own = {name: f"w{rng.randrange(10**6)} {i}" for name, same in parts if not same}
        rows.append("<body>" + "".join(f"<div class='{name}'><p>{own.get(name, 'as ever ' + name)}</p></div>" for name, _ in parts) + "</body>")
        want.append("\n".join(own[name] for name, same in parts if not same))

    got = _texts(spark, rows)
    # The lowest element that holds all slots is the body; template text within it goes.
    assert got == want


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<li>" * 100_000 + "x", "<div><p>y" * 50_000, "<script " * 40_000, "<script >" * 40_000, "<a href='" * 40_000, "<svg " * 40_000 + ">", "<!-- " * 40_000, "</div>" * 100_000, "<div a=\"" * 30_000 + ">"])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page, set())
    assert time.process_time() - began < 4


def test_deep_hosts_take_linear_time():
    n = 50_000
    rows = pd.DataFrame({"path": range(n), "parent": [max(0, i - 1) for i in range(n)], **dict.fromkeys(("named", "articles", "nevers"), 0), "pages": 1, "n": 1, "sig": 7, "chars": 5, "direct": 1, "least": 1, "most": 1})
    began = time.process_time()
    assert html_text.deduced(rows) == ([1], [])
    assert time.process_time() - began < 4


def test_classes_tell_template_text_from_slots(spark):
    page = "<body><div id=top><p>Our town since 1990</p></div><div id=c><h1>title {i}</h1><p>always here</p><p>{w}</p></div><div id=end>Made by us</div></body>"
    pages = [(i, f"http://a.example.com/{i}", page.format(i=i, w="word " * (i + 3))) for i in range(5)] + [(9, "http://b.example.com/", page.format(i=9, w="x"))]
    # No other token stands as often as each of these two, so neither is in the template.
    pages += [(10 + i, f"http://c.example.com/{i}", "<body>" + "<section>" * (i > 0) + f"<i>a{i}</i>" + f"<article>text {i}</article>" * (i > 1) + "</section>" * (i > 0) + f"<p>tail {i}</p></body>") for i in range(5)]
    rows = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert rows[3] == "title 3\nalways here\n" + ("word " * 6).strip()
    assert rows[9] == "Our town since 1990\ntitle 9\nalways here\nx\nMade by us"
    assert rows[13] == "a3\ntext 3\ntail 3"


# Pipeline


def test_one_id_with_two_texts(spark):
    """Rows are told apart by id and text: the near copy goes whatever its id, another text under that id stays; equal rows are one."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, a), (2, b), (2, b), (None, a), (None, "c d"), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, SF).collect()
    assert collections.Counter(tuple(r) for r in kept) == collections.Counter([(1, a), (2, b), (None, "c d"), (3, ""), (4, None)])


def test_pipeline_by_brute_force(spark):
    """Each stage on its own input: what must go goes, what must stay stays."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, SF).cache()
    failed = {r.doc_id for r in docs.select("doc_id", quality.base_failed(quality.features(F.col("text"))).alias("f")).collect() if r.f}
    assert not failed & {r.doc_id for r in kept.collect()}
    lines = stages["line_dedup"](spark, kept, SF).cache()
    assert lines.count() == kept.count() and lines.where("n_chars != length(text)").isEmpty()
    one = stages["ngram_jaccard"](spark, lines, SF).cache()
    order = [(r.doc_id, r.text) for r in lines.orderBy("doc_id").collect()]
    groups = _brute([t for _, t in order])
    assert sorted(r.doc_id for r in one.collect()) == [order[i][0] for i, _, top in groups if i == top]
    mixed = stages["mixing"](spark, one, SF).cache()
    assert mixed.columns == docs.columns and mixed.join(one, "doc_id", "left_anti").isEmpty()
    out = stages["sentencepiece"](spark, mixed, SF)
    assert out.where("NOT round_trip").isEmpty() and out.count() >= mixed.count()

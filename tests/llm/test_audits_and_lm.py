"""Language model, filter audit and source audit against plain versions, and their hard cases."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from pairwright.llm import filter_audit, maxent, source_audit
from pairwright.llm.transducer import Transducer

SMALL = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n long, token string, class string, term string, "
          "ordinal int, mask string, part string, quality int, toxic int")
LONG = "lorem ipsum dolor " * 30_000
TEXTS = [(1, None), (2, ""), (3, " \t\n"), (None, "null id " * 30), (4, "same words here Again " * 60),
         (4, "same words here Again " * 60), (5, "same words here Again " * 60), (6, LONG), (7, "é 日本語 x\x00y"), (8, "one"),
         (9, "w" * 100_000 + " one")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a" if i != 8 else None, f"s{(i or 0) % 2}" if i != 7 else None,
                                   1, "x", "y", "z", 2, "m", "p", 1, 1) for i, t in rows], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text)) + [None]


def base(rows, held):
    """{row number: (n_tokens, n_known, base_score)}, N"""
    train = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, unit = sum(train.values()), sum(train.values()) + 0.5 * (len(train) + 1)
    out = []
    for i, text in rows:
        own = tokens(text)
        out.append((i, len(own), sum(train[t] > 0 for t in own), sum(math.log10((train[t] + 0.5) / unit) for t in own)))
    return out, total


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def same(got, want):
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9, abs=1e-9)


def test_lm_query_equals_counting(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = E.queries()["op11_lm_scoring"](spark, SMALL).collect()
    want, total = base(rows, is_held)
    same([(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got], want)
    assert all(r.held_out == is_held(r.doc_id) and r.train_tokens == total and r.score < 0 for r in got)
    own = [r for r in got if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own) + 0.03 * sum(r.n_tokens for r in own)


@pytest.mark.parametrize("frequent", [0, 3, 400_000])
def test_lm_hard_cases(spark, frequent, monkeypatch):
    monkeypatch.setattr(maxent, "FREQUENT", frequent)
    docs = frame(spark, TEXTS)
    model, counts = maxent.fit(docs, F.col("doc_id") % 2 == 0)
    got = maxent.score(docs, model, counts).collect()
    want, _ = base(TEXTS, lambda i: i is not None and i % 2 == 1)
    same([(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got], want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    none, counts = maxent.fit(docs.limit(0), F.lit(True))
    assert maxent.score(docs.limit(0), none, counts).count() == 0
    assert all(r.base_score == 0 and r.n_known == 0 for r in maxent.score(docs, none, counts).collect())


def test_lm_scores_do_not_depend_on_where_counts_are(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model, counts = maxent.fit(docs, F.col("doc_id") % 4 > 0)
    near = {r.doc_id: r.score for r in maxent.score(docs, model, counts).collect()}
    model.frequent, model.frequent_hashes, model.cut = model.frequent.slice(0, 0), model.frequent_hashes[:0], 1 << 30
    far = {r.doc_id: r.score for r in maxent.score(docs, model, counts).collect()}
    assert near.keys() == far.keys() and all(near[i] == pytest.approx(far[i], rel=1e-9) for i in near)


def test_lm_probabilities_sum_to_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(50)
    model, counts = maxent.fit(docs, F.lit(True))
    assert np.abs(model.class_rows).max() > 0
    feature = np.array([[5], [7], [9]], dtype=np.uint64)
    words = counts.collect()
    hashes = np.array([r["hash"] for r in words], dtype=np.int64).view(np.uint64)
    classes, slot = np.array([r["class"] for r in words]), model.slots(hashes)
    p = 10 ** model.log10(np.repeat(feature, len(words), axis=1), classes, slot)
    unit = (model.rest_total + 0.5 * (model.rest_types + 1))[classes]
    total = np.where(slot > 0, p, p * (np.array([r["c"] for r in words]) + 0.5) / unit).sum()
    for c in range(maxent.CLASSES):      # one unknown word of each class
        rest = 10 ** model.log10(feature, np.array([c]), np.array([0]))[0]
        total += rest * 0.5 / (model.rest_total[c] + 0.5 * (model.rest_types[c] + 1))
    assert total == pytest.approx(1.0, abs=1e-4)


def audit(rows, good, toxic):
    """{(part, order, step): counts} of plain loops."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    docs = []
    for i, t, part in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {k for k, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w),
                                            100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)),
                                            i is not None and i > first[t])) if x}
        docs.append((part, fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            here, left = "".join(order), [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                lost = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                left, gone = [d for d in left if f not in d[1]], gone + lost
                shapley[f] += len(lost)
                out[part, here, step] = [len(left), len(lost), redundant, sum(d[1] == {f} for d in docs if d[0] == part),
                                         sum(d[2] for d in lost), sum(d[3] for d in lost)]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_against_loops(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "B", "c#", "dd", "Ee", "f"]) if rng.random() < 0.6 else f"w{rng.random()}"
                      for _ in range(rng.choice([0, 3, 199, 200, 201, 260]))) for _ in range(14)]
    rows = [(i if i != 17 else None, rng.choice([*texts, None, ""]), rng.choice(["x", "y", "", None])) for i in range(60)]
    rows += [rows[3], rows[3], (None, rows[5][1], "x")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, part int, mask int")
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, 7])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = audit([(i, t or "", p or "") for i, t, p in rows], {i for i, q, _ in labels if q == 1 and i is not None},
                 {i for i, _, x in labels if x == 1 and i is not None})
    got = filter_audit.interactions(filter_audit.cells(docs, marks)).collect()
    assert len(got) == len(want) == 600 * 3
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == want
    assert filter_audit.interactions(filter_audit.cells(docs.limit(0), marks)).count() == 0
    assert filter_audit.interactions(filter_audit.cells(docs, marks.limit(0))).filter("good_lost + toxic_lost > 0").count() == 0


def test_filter_audit_hard_cases(spark):
    docs = frame(spark, TEXTS)
    out = {(r.part, r.filter_order, r.step): r for r in filter_audit.interactions(filter_audit.cells(docs, docs)).collect()}
    assert {k[0] for k in out} == {"s0", "s1", ""} and len(out) == 1800
    assert sum(out[p, "EABCD", 1].removed for p in ("s0", "s1", "")) == 2      # 5 copies 4, 2 copies 1; 3 is blank but differs
    assert sum(out[p, "EABCD", 1].kept + out[p, "EABCD", 1].removed for p in ("s0", "s1", "")) == len(TEXTS)


def plain_audit(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", term.findall(lower(text))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted((t for t, n in df.items() if n >= min_docs), key=lambda t: t.encode())
        sources = sorted({d[1] for d in docs if d[0] == lang})
        counts = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2]) for s in sources}
        counts[None] = sum(counts.values(), Counter())

        def share(own):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10 ** 9 * (own[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: share(c) for s, c in counts.items()}
        for s in sources:
            far = [(r, sum(abs(p[s][t] - p[r][t]) for t in kept)) for r in sources if r != s]
            own = [(t, p[s][t] - p[None][t]) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found, n in (("pair", far, len(far)), ("term", own, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:n]
                out |= {(lang, s, part, x, value, k) for k, (x, value) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("far", [False, True])
def test_source_audit_against_loops(spark, far, monkeypatch):
    rng = random.Random(8)
    words = ["Alpha", "beta", "été", "日本", "ab", "abc", "a", "z", "Straße", "ÉTÉ", "x" * 300, *[f"t{chr(97 + i)}" for i in range(20)]]
    rows = [(" ".join(rng.choice(words[:rng.randint(1, len(words))]) + rng.choice(["", ".", "1", "_"]) for _ in range(rng.randint(0, 40))),
             rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "é3", None])) for _ in range(150)]
    rows += [(None, "en", "only null"), ("1234", "xx", "a"), ("", "xx", "b"), *[rows[0]] * 9]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "text string, lang string, source string, n int, term string")
    # the other way: terms dealt out to buckets; blocks of few ordinals and of some sources
    if far:
        monkeypatch.setattr(source_audit, "CELLS", 7)
        monkeypatch.setattr(source_audit, "PAIRS", 6)
    kind = {"broadcast_terms": 0, "bucket_terms": 4} if far else {}
    got = source_audit.divergence(docs, min_docs=5, top=6, **kind).collect()
    want = plain_audit(rows, 5, 6)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert source_audit.divergence(docs.limit(0), **kind).count() == 0


@pytest.mark.parametrize("held", [1, 12, 40, 1000])
def test_source_audit_sums_of_many_chunks(held, monkeypatch):
    monkeypatch.setattr(source_audit, "HELD", held)        # passed, by half and whole, between two chunks
    monkeypatch.setattr(source_audit, "CHUNK", 60)
    rng = random.Random(9)
    terms = sorted(f"t{chr(97 + i)}".encode() for i in range(20))
    texts = [" ".join(rng.choice(terms).decode() for _ in range(10)) for _ in range(80)]
    sources = [rng.choice(["s1", "s2"]) for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 80), pa.array(sources), pa.array(texts)], ["lang", "source", "text"])
    got = Counter()
    for out in source_audit._recount_task({"en": Transducer.build(terms).to_bytes()})([batch, batch]):
        for _, source, ordinal, n in zip(*(c.to_pylist() for c in out.columns)):
            got[source, terms[ordinal].decode()] += n
    assert got == Counter({k: 2 * n for k, n in Counter((s, t) for s, x in zip(sources, texts) for t in x.split()).items()})


def test_source_audit_hard_cases(spark):
    docs = frame(spark, TEXTS)
    got = source_audit.divergence(docs, min_docs=2).collect()
    want = plain_audit([(r.text, r.lang, r.source) for r in docs.collect()], 2, 50)
    assert {tuple(r) for r in got} == want


def test_transducer():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdé日") for _ in range(rng.randint(1, 7))).encode() for _ in range(3000)})
    machine = Transducer.from_bytes(Transducer.build(words).to_bytes())
    ask = words + [w + b"q" for w in words[:50]] + [w[:-1] for w in words[:50]] + [b"", b"\xff" * 50]
    data = np.frombuffer(b"".join(ask), np.uint8)
    sizes = np.array([len(w) for w in ask])
    want = {w: i for i, w in enumerate(words)}
    assert machine.ordinals(data, np.cumsum(sizes) - sizes, sizes).tolist() == [want.get(w, -1) for w in ask]
    # minimal: no two states accept the same endings
    endings = {}
    for state in range(len(machine.final) - 1, -1, -1):
        arcs = [(int(k) % 256, int(t)) for k, t in zip(machine.keys, machine.target) if k // 256 == state]
        sign = (bool(machine.final[state]), tuple(arcs))
        assert endings.setdefault(sign, state) == state
    assert Transducer.build([]).ordinals(data, np.cumsum(sizes) - sizes, sizes).max() == -1
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])

"""The pipeline stage by stage on a small folder with nulls, blanks, copies and planted passages, against plain versions."""

import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from pairwright.llm import packing, secret_scan, token_counts, tokens, toxicity

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module", params=["rows", "empty"])
def folder(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp(f"pipeline-{request.param}"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    base = [tuple(r) for r in docs.limit(60).collect()]
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(300))
    extra = [None, "", " \t\n", None, "", base[0][1], base[0][1], items[0], "some words before " + items[1],
             " ".join(rng.choice(words) for _ in range(400)) + " " + items[2], long, long + " end", "api_key = abcdefgh12345 " + " ".join(words[:90]),
             "lone"]
    rows = base + [(10_000 + i, t, None if i % 3 else "en", "x", len(t) if t is not None else None) for i, t in enumerate(extra)]
    rows += [(None, "null id words here", "en", "x", 18), base[1], (20_000, None, None, None, None), (20_000, None, None, None, None)]
    made = spark.createDataFrame(rows if request.param == "rows" else [], DOCS)
    made.repartition(3).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """What goes into each stage and comes out of it."""
    out, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, apply) in enumerate(P.STAGES):
        to = f"{tmp_path_factory.mktemp('stages')}/{i}"
        apply(spark, docs, folder).write.parquet(to)
        done = spark.read.parquet(to)
        out.append((name, docs, done))
        docs = done
    return out


def test_columns_and_names(stages):
    assert [s[0] for s in stages] == ["toxicity", "simhash_near_dedup", "decontamination", "secret_scan", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after.schema == before.schema


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_toxicity_keeps_what_scores_low_and_what_is_blank(spark, folder, stages):
    _, before, after = stages[0]
    model = toxicity.fit(before, spark.read.parquet(f"{folder}/labels.parquet"), allowed=P.outside_held_out())
    scored = before.select("*", toxicity.score("text", model).alias("s"), toxicity.threshold("lang", model).alias("t")).collect()
    assert rows_of(after) == sorted((tuple(r)[:5] for r in scored if not WORD.search(r.text or "") or r.s < r.t), key=repr)


def fingerprint(text):
    words = WORD.findall(lower(text))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = np.array([xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h)) if grams else 0


def test_one_of_each_near_copy_and_all_blanks(stages):
    _, before, after = stages[1]
    rows = [tuple(r) for r in before.collect()]
    prints = [fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        if find(i) not in best or key < best[find(i)][0]:
            best[find(i)] = (key, i)
    kept = {i for _, i in best.values()}
    want = [r for i, r in enumerate(rows) if i in kept or not WORD.search(r[1] or "")]
    assert rows_of(after) == sorted(want, key=repr)
    if rows:
        assert sum(not WORD.search(r[1] or "") for r in want) == 7


def test_contaminated_go(spark, folder, stages):
    _, before, after = stages[2]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    spans = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = word.findall(lower(r.text))
        spans |= {tuple(w[i:i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(s) for s in spans}

    def clean(text):
        w = word.findall(lower(text))
        hit = {p for n in sizes for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in spans for p in range(i, i + n)}
        return not (hit and 20 * len(hit) >= len(w))

    assert rows_of(after) == sorted((tuple(r) for r in before.collect() if clean(r.text)), key=repr)


def test_secrets_are_replaced_in_place(stages):
    _, before, after = stages[3]
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", re.A)
    got = {r.doc_id: r for r in after.collect()}
    assert after.count() == before.count() and set(got) == {r.doc_id for r in before.collect()}
    for r in before.collect():
        text = got[r.doc_id].text
        assert (text is None) == (r.text is None)
        if r.text is not None:
            assert got[r.doc_id].n_chars == len(text)
            assert not assign.search(text.replace("[SECRET]", " ")) and ("[SECRET]" in text or text == r.text or "[SECRET]" in r.text)
            assert not assign.search(r.text) or "[SECRET]" in text


def test_pieces_hold_every_token_once(stages):
    _, before, after = stages[4]
    coder = tokens.encoder(tokens.default_vocabulary())
    want = sorted(zlib.crc32(np.array([*coder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
                  for r in before.collect())
    pieces = after.collect()
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert sum(p.start == 0 for p in pieces) == len(want)
    whole = [p.ids_crc32 for p in pieces if p.length == p.doc_tokens]
    assert not set(whole) - set(want) and all(p.length <= 1024 for p in pieces)


def test_run_is_the_stages_one_after_another(spark, folder, stages):
    got, want = E.queries()["pipeline"](spark, folder), stages[-1][2]
    columns = ["doc_id", "start", "length", "doc_tokens"]
    assert got.columns == want.columns
    assert got.agg(F.sum("length")).first() == want.agg(F.sum("length")).first()
    assert rows_of(got.filter("start = 0").select("doc_id", "doc_tokens")) == rows_of(want.filter("start = 0").select("doc_id", "doc_tokens"))
    assert set(columns) <= set(got.columns)


def test_a_megabyte_of_blanks(spark):
    coder = tokens.encoder(tokens.default_vocabulary())
    for blank in (" ", "\t", "\n", " \n"):
        text = "word" + blank * (1_000_000 // len(blank))
        began = time.monotonic()
        got = coder.ids(text)
        assert time.monotonic() - began < 1
        assert got.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, "word" + " " * 1_000_000, "x")], "doc_id long, text string, lang string")
    assert packing.pack_documents(docs).agg(F.sum("length")).first()[0] == len(coder.ids("word" + " " * 1_000_000)) + 1
    assert token_counts.section_tokens(docs).count() == 1
    assert secret_scan.KINDS

"""Each operator against a plain version on small tables made to hold its hard cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pairwright.llm import (embedding_dedup, html_main, packing, secret_scan, sharding, simhash, substring_dedup,
                            token_counts, tokens, toxicity)
from pairwright.llm.shared import components

SMALL = "/root/testdata/sf0.001"
WORDS = ["alpha", "beta", "gamma", "delta", "of", "the", "a", "Zeta,", "é", "42"]


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def near_texts(seed=3, groups=12, words=60):
    """Texts in groups that differ by a word here and there, with exact copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(words)] = rng.choice(vocabulary)
            out.append(" ".join(own))
    return out


def union_find(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_ids_and_spans_equal_the_tokenizer(spark):
    coder = tokens.encoder(tokens.default_vocabulary())
    odd = ["", "a", "  a  b", "foo\n\n bar  ", "x\x1c\x1d y", "　z\x85 q​k", "it's  don't\t\tI'm  'll",
           "<|endoftext|> a  <|endoftext|>", "é 日本語。ok 🙂🙂 \xa0\xa0z", " " * 50 + "x" + "\n" * 9, "a  b \n c\t\td \n"]
    for text in odd + [r.text for r in table(spark, "documents").limit(40).collect()]:
        want = coder.tokenizer.encode(text, add_special_tokens=False)
        got = coder.ids(text)
        assert got.tolist() == want.ids
        assert list(zip(*(x.tolist() for x in coder.spans(text, got)))) == want.offsets


def test_token_counts(spark):
    docs = table(spark, "documents").limit(60)
    coder = tokens.encoder(tokens.default_vocabulary())
    want = {}
    for r in docs.collect():
        sections = token_counts.line_spans(r.text) or [(0, len(r.text))]
        counts = [0] * len(sections)
        for a, b in coder.tokenizer.encode(r.text, add_special_tokens=False).offsets:
            shared = [min(b, e) - max(a, s) for s, e in sections]
            if max(shared) > 0:
                counts[shared.index(max(shared))] += 1
            else:
                before = [i for i, (s, _) in enumerate(sections) if s <= a]
                counts[before[-1] if before else 0] += 1
        want[r.doc_id] = counts
    got = {}
    for r in token_counts.section_tokens(docs).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(r.n_tokens)
    assert got == want


def test_attribution_rule():
    left, right = np.array([0, 2, 4, 6, 9]), np.array([2, 4, 6, 9, 12])
    section, crossing = token_counts.attribute(left, right, np.array([0, 5, 10]), np.array([5, 7, 12]))
    #               in 0, in 0, half and half: the first, 1 of 3 in section 1, 2 of 3 in section 2
    assert section.tolist() == [0, 0, 0, 1, 2] and crossing.tolist() == [False, False, True, True, True]


def test_packing_round_trip_and_padding(spark):
    docs = table(spark, "documents")
    coder = tokens.encoder(tokens.default_vocabulary())
    ids = {r.doc_id: [*coder.tokenizer.encode(r.text, add_special_tokens=False).ids, 0] for r in docs.collect()}
    pieces = packing.pack_documents(docs).collect()
    for doc_id, own in ids.items():
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(own)
            body = np.array(own[at: at + p.length], dtype="<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(body)
            at += p.length
        assert at == len(own)
    windows = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == windows.get(p.sequence_id, 0)
        windows[p.sequence_id] = p.offset + p.length
    assert max(windows.values()) <= 1024
    assert sum(windows.values()) / (1024 * len(windows)) > 0.97


def test_cuts_are_the_cheapest():
    rng = random.Random(5)
    for _ in range(40):
        at, penalty = [0], [0.0]
        for _ in range(rng.randint(1, 12)):
            at.append(at[-1] + rng.randint(1, 8))
            penalty.append(rng.choice([0.0, 1.0, 5.0]))

        def cost(cuts):
            return sum(10 - (at[j] - at[i]) + penalty[j] for i, j in zip(cuts, cuts[1:]))

        n = len(at) - 1
        options = []
        for mask in range(1 << (n - 1)):
            cuts = [0, *[i for i in range(1, n) if mask >> (i - 1) & 1], n]
            if all(at[j] - at[i] <= 10 for i, j in zip(cuts, cuts[1:])):
                options.append(cost(cuts))
        assert cost(packing.choose_cuts(at, penalty, 10)) == min(options)


def test_base_spans(spark):
    rows = ["token: token: abcdefg", 'PassWord = "abc123" API_key:xyz7890', "ſecret=abcdef secret=ab-cd.e", "AKIA" + "A1" * 8 + "x",
            "AKIA" + "A1" * 7, "é" + "0123456789abcdef" * 2 + "g", "f" * 23, "secret='" + "ab" * 12 + "'"]

    def plain(text):
        found = []
        assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
        found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        return [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(found)]

    for text in rows + [r.text for r in table(spark, "documents").collect()]:
        assert [s[:3] for s in secret_scan.base_spans(text)] == plain(text)
    assert secret_scan.redact_text("x secret='" + "ab" * 12 + "' y", [("assign", 2, 34), ("hex", 10, 34)], "#") == "x #' y"


def secrets_corpus(n=400, seed=1):
    rng = random.Random(seed)
    key = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    out = []
    for i in range(n):
        words = [rng.choice(["and", "the", "Hand", "over", "of", "in,", "long.", "sea", "10-12", "a.b@c.org"]) for _ in range(50)]
        if i % 3 == 0:
            words.insert(rng.randrange(50), rng.choice([f"password={key(18)}", f'token = "{key(40)}"', f"secret: {key(20)}"]))
        out.append(" ".join(words))
    return out


def test_crf_finds_what_the_patterns_miss_and_spares_prose(spark):
    docs = spark.createDataFrame(list(enumerate(secrets_corpus())), "doc_id long, text string")
    model = secret_scan.train(docs)
    tagger = secret_scan.Tagger(model)
    missed = 'and the sea passphrase = "9f8e7d6c5b4a39281706f5e" in the long hand'
    assert secret_scan.base_spans(missed) == []
    (kind, a, b), = secret_scan.scan(missed, tagger)
    assert kind == "crf" and missed[a:b] == "9f8e7d6c5b4a39281706f5e"
    assert all(s[0] != "crf" for r in docs.collect() for s in secret_scan.scan(r.text, tagger))


def test_training_windows_of_skewed_and_rare_secrets(spark):
    texts = secrets_corpus(400, 3)
    many = " and ".join(t for t in texts[:60:3])         # twenty secrets, in most rows
    docs = spark.createDataFrame(list(enumerate(texts + [many] * 1500)), "doc_id long, text string")
    rows = secret_scan.sample_windows(docs, "text", windows=50)
    assert [sum(r["sort"] == s for r in rows) for s in (0, 1)] == [50, 50]
    prose = [f"the sea and the long hand {i}" for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(prose + texts[:9])), "doc_id long, text string")
    rows = secret_scan.sample_windows(docs, "text", sample_docs=30)
    want = {w[1:2] + (tuple(w[2]),) for t in texts[:9] for w in secret_scan._windows(t) if w[0] == 1}
    assert len(want) == 3 and {(r["i"], tuple(r["tokens"])) for r in rows if r["sort"] == 1} == want
    assert 0 < sum(r["sort"] == 0 for r in rows) < 200


def test_viterbi_equals_decoding_every_token(spark):
    model = secret_scan.train(spark.createDataFrame(list(enumerate(secrets_corpus(200, 2))), "doc_id long, text string"))
    tagger = secret_scan.Tagger(model)
    text = " ".join(secrets_corpus(30, 9))
    found = secret_scan.TOKEN.findall(text)
    kinds = [secret_scan.EDGE] * 3 + [secret_scan.token_class(t) for t in found] + [secret_scan.EDGE] * 2
    file = model.file[secret_scan.file_features(np.array(kinds[3:-2]))].sum(axis=0)
    emit = []
    for i, t in enumerate(found):
        e = model.own[secret_scan.own_features(t)].sum(axis=0) + file
        e = e + sum(model.near[k][kinds[i + d + 3]] for k, d in enumerate(secret_scan.NEAR))
        emit.append(e + model.words[model.known.get(found[i - 1].lower(), 0) if i else 0])
    states = secret_scan._viterbi(np.array(emit), model.move)
    begins = [secret_scan.TOKEN.finditer(text)]
    at = [m.start() for m in begins[0]]
    want = [at[i] for i, s in enumerate(states) if s == secret_scan.BEGIN or s == secret_scan.IN and (not i or not states[i - 1])]
    assert want and [a for a, _ in tagger.spans(text)] == want


def test_substring_dedup(spark):
    rng = random.Random(8)
    texts = near_texts(seed=8, groups=8, words=90) + ["x " * 70, "x " * 41, " ".join(rng.choice(WORDS) for _ in range(300))]
    texts += [texts[0], " ".join(texts[1].split()[30:60])]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[2])]
    seen, want = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = t.split()
        gone = set()
        for s in range(len(words) - 19):
            w = tuple(words[s: s + 20])
            if w in seen:
                gone.update(range(s, s + 20))
            seen.add(w)
        kept = [w for j, w in enumerate(words) if j not in gone]
        want[i] = (len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    out = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), with_text=True)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()}
    assert got == want and sum(v[1] > 0 for v in want.values()) > 5


def test_rendezvous(spark):
    docs = table(spark, "documents")
    got = sharding.shard_records(docs, [1.0] * 40).collect()

    def score(key, shard):
        h = xxhash.xxh64_intdigest(key.encode(), 42)
        h = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), h)
        return h - (1 << 64) if h >= 1 << 63 else h

    body = {r.doc_id: r.text.encode() for r in docs.collect()}
    for r in got:
        scores = [score(str(r.doc_id), s) for s in range(41)]
        assert r.shard == int(np.argmax(scores[:40])) and r.grown_shard in (r.shard, 40)
        assert (r.grown_shard == 40) == (max(scores) == scores[40])
        assert r.size == len(body[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(body[r.doc_id])
    keys = spark.range(20_000).select(sharding.place(F.col("id").cast("string"), [1.0, 3.0]).alias("s"))
    assert 0.73 < keys.filter("s = 1").count() / 20_000 < 0.77


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    x = np.concatenate([centres[rng.integers(0, 60, 900)] + rng.normal(scale=0.16, size=(900, 32)),
                        centres[:1] + rng.normal(scale=0.02, size=(300, 32)), rng.normal(size=(400, 32))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    want = linked.sum(axis=1)
    out = embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    got = {r.vec_id: r for r in out.collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and want.sum() > 50_000 and found.sum() >= 0.98 * want.sum()
    roots = union_find(len(x), np.argwhere(linked))
    assert np.mean([got[i].component_id == roots[i] for i in range(len(x))]) > 0.97


def test_blocks_of_a_crowded_leaf(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(1)
    x = np.ones((300, 8)) + rng.normal(scale=0.001, size=(300, 8))
    out = embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert {(r.n_links, r.component_id) for r in out.collect()} == {(299, 0)}


def test_toxicity_learns(spark):
    rng = random.Random(2)
    bad = ["grumph", "snarl", "vexed"]
    rows, labels = [], []
    for i in range(900):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 80))]
        if toxic := i % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), rng.choice(["en", "de"])))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, own, allowed=F.col("doc_id") < 700)
    scored = docs.filter("doc_id >= 700").select("doc_id", toxicity.score("text", model).alias("s")).join(own, "doc_id").collect()
    assert np.mean([(r.s >= 0.5) == bool(r.toxic) for r in scored]) > 0.9
    swapped = docs.withColumn("lang", F.lit("xx")).select(toxicity.score("text", model).alias("s"))
    assert swapped.exceptAll(docs.select(toxicity.score("text", model).alias("s"))).count() == 0


def test_toxicity_thresholds_cover_all_labels(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(3000):
        toxic = i % 4 == 0
        lang = "qq" if rng.random() < 0.08 else "en"
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 30))]
        # a bad word is an ordinary one of half the language qq
        words += [rng.choice(["grumph", "snarl"])] * (toxic or lang == "qq" and rng.random() < 0.5) + ["vexed"] * toxic
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, own, per_class=60)
    assert set(model.thresholds) == {"en", "qq"}
    got = docs.select("doc_id", "lang", toxicity.score("text", model).alias("s"),
                      toxicity.threshold("lang", model).alias("t")).join(own, "doc_id").collect()
    for lang in ("en", "qq"):
        s, y = (np.array([r[c] for r in got if r.lang == lang]) for c in ("s", "toxic"))
        f1 = lambda cut: 2 * (y * (s >= cut)).sum() / (y.sum() + (s >= cut).sum())
        assert f1(model.thresholds[lang]) >= max(map(f1, s)) - 0.05
    shuffled = toxicity.fit(docs, own, per_class=60, broadcast_labels=0)
    assert (shuffled.thresholds, shuffled.intercept) == (model.thresholds, model.intercept)


def test_score_depends_on_the_text_alone():
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.normal(size=(toxicity.PAD + 1, toxicity.DIM)).astype(np.float32),
                           [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
                           np.zeros(24, np.float32), rng.normal(size=24).astype(np.float32), 0.0)
    model.embedding[toxicity.PAD] = 0
    counts = np.array([3, 0, 1, 7, 2])
    rows = rng.integers(0, toxicity.PAD, (counts.sum(), toxicity.HASHES)).astype(np.int32)
    alone = [model.log_odds(r, np.array([len(r)]))[0] for r in np.split(rows, np.cumsum(counts)[:-1])]
    assert np.allclose(model.log_odds(rows, counts), alone, atol=1e-3)


def test_best_threshold_of_bins():
    rng = np.random.default_rng(5)
    for _ in range(50):
        bins = np.unique(rng.integers(-200, 200, 30))
        pos, neg = rng.integers(0, 9, len(bins)).astype(float), rng.integers(0, 9, len(bins)).astype(float)
        cut = toxicity._best_threshold((bins + 0.5) / toxicity.BINS, pos, neg)
        f1 = lambda edge: 2 * pos[bins >= edge].sum() / (pos[bins >= edge].sum() + neg[bins >= edge].sum() + pos.sum())
        assert np.isclose(f1(np.log(cut / (1 - cut)) * toxicity.BINS - 1e-6), max(map(f1, bins)))


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    texts = near_texts() + [r.text for r in table(spark, "documents").limit(60).collect()] + ["", None, "a b", "A b", "ÀB c d É"]
    out = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    prints = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = union_find(len(texts), pairs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in out.collect()}
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in range(len(texts))} and len(pairs) > 5


def test_large_buckets_are_keyed_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = random.Random(6)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << rng.randrange(24) for _ in range(rng.randint(0, 6))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    values = sorted(v - (1 << 64) if v >= 1 << 63 else v for v in values)
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    got = {r.node: r.root for r in components(edges).collect()}
    at = {v: i for i, v in enumerate(values)}
    pairs = [(i, j) for i, a in enumerate(values) for j, b in enumerate(values[:i]) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    roots = union_find(len(values), pairs)
    assert [at[got.get(v, v)] for v in values] == roots


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(300)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="layout has-sidebar"><{tag} class="{cls}"><h1>Head &amp; line</h1><p>First <b>bold</b><br>line.<p>Second&nbsp;one &lt;x&gt;
<div class="ad">Buy!</div><form><label>Mail</label></form><p>Third, %s.</p></{tag}><aside>Side</aside></div>
<div id="comments"><p>A reader says a lot here.</p></div><footer>&copy; x</footer></body>"""


def test_html(spark):
    body = "with quite some more text to read " * 5
    rows = [(i, f"https://host{i % 3}.example/{i}", (PAGE % body).replace("{tag}", tag).replace("{cls}", f"post-{i}"))
            for i, tag in enumerate(["article", "div", "section"] * 4)]
    # a page whose own best container would be the comments
    odd = PAGE.replace("A reader says a lot here.", "A reader says a lot here. " * 40).replace("{tag}", "div").replace("{cls}", "post-9")
    rows.append((99, "https://host1.example/99", odd % "short"))
    out = {r.page_id: r for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert out[i].text == f"Head & line\n\nFirst bold line.\n\nSecond one <x>\n\nThird, {body.strip()} .".replace(" .", " .")
        assert out[i].n_chars == len(out[i].text)
    assert out[99].text == "Head & line\n\nFirst bold line.\n\nSecond one <x>\n\nThird, short."


def test_html_keeps_the_whole_article(spark):
    long = "quite some running text of the article " * 20
    menu, foot = "<nav><a href=/>Menu</a></nav>", "<div class=comments><p>" + "A reader. " * 30 + "</div><footer>End</footer>"
    bodies = {
        "div-only": f"<div class=post><h1>T</h1><div class=intro>Intro.</div><div class=entry><p>{long}</p></div></div>",
        "nested": f"<div class=post><header><h1>T</h1></header><div class=intro>Intro.</div><div class=a><div class=b><p>{long}</p></div></div></div>",
        "sections": f"<div class=post><h1>T</h1><section class=part-1><p>Intro.</p></section><section class=part-2><p>{long}</p></section></div>",
        "articles": f"<div class=list><article><h1>T</h1><p>Intro.</p></article><article><p>{long}</p></article></div>",
        "body": f"<h1>T</h1><p>Intro.</p><div><a href=/x>Links</a> <a href=/y>only</a></div><div class=entry><p>{long}</p></div>",
    }
    rows = [(n, f"https://{name}.example/{n}", f"<body>{menu}{body}{foot}</body>") for name, body in bodies.items() for n in range(3)]
    # a host's page that has the winning path, and more text beside it
    rows.append((9, "https://div-only.example/9", f"<body>{menu}<div class=post><h1>T</h1><div class=entry><p>Intro.</p></div>"
                                                  f"<div class=more><p>{long}</p></div></div>{foot}</body>"))
    out = html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 16
    for r in out:
        assert r.text == f"T\n\nIntro.\n\n{long.strip()}", r.url

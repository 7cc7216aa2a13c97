"""Secret scan: fixed patterns and a linear-chain conditional random field.

Base spans come from three patterns (see ``base_spans``).  A CRF tags the
tokens of every whole text as begin, inside or outside of a secret, from the
token's shape, the words around it and features of the file, and is decoded by
Viterbi; its spans that meet no base span are added as kind ``crf``.

The CRF learns from base spans as labels, on token windows around them (out of
all documents) and around tokens that merely look odd (out of about
``SAMPLE_DOCS`` different texts), with at most ``WINDOWS`` windows of each sort.  What it adds are
tokens that look and stand like known secrets but escape the patterns.

Decoding is exact without visiting every token in Python: a token whose best
score for begin or inside stays below that of outside by more than any
transition can give back is outside on the best path, so only the stretches
between such tokens run through Viterbi.  (``Crf.slack`` is what transitions can
give back.)

Null or empty text: no spans.  Without a base span in any text there is no
CRF.  Repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage

SAMPLE_DOCS = 16_000      # different texts, about, that windows without a secret come from
WINDOWS = 1_000           # windows of each sort that it learns from
AROUND = 15               # tokens on each side of a window's middle
CACHED_TOKENS = 500_000   # scored tokens held in a task
SEEN = 100_000            # hashes of texts that a task remembers, to pass over copies

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE = 6
KINDS = ("assign", "access", "hex")
_WORDS_BEFORE = ("passw", "secret", "token", "api")      # every assign match holds one, in either case

# Holds for every text with a base span (Java and Python alike).
MAY_HOLD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""

SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """``(kind, start, end, start of the secret itself)`` by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS_BEFORE):
        found += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span(), m.start()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# --- tokens and features -------------------------------------------------

TOKEN = re.compile(r"[\w+/.-]+|[^\w\s+/.-]+")
_KEYWORD = re.compile(r"(?ai)pass|pwd|secret|token|key|cred|auth|akia")
_HEX = re.compile(r"[0-9a-fA-F]+")
_LENGTHS = (1, 4, 8, 12, 16, 20, 28, 36, 48)
# what a token looks like to its neighbours
PLAIN, KEYWORD, EQUALS, COLON, QUOTE, MARK, NUMBER, ODD, EDGE = range(9)
N_CLASSES = 9
N_OWN = len(_LENGTHS) + 14
NEAR = (-3, -2, -1, 1, 2)
N_FILE = 6


@lru_cache(maxsize=200_000)
def token_class(token: str) -> int:
    if token.isalpha():
        return KEYWORD if _KEYWORD.search(token) else PLAIN
    if not (token[0].isalnum() or token[0] in "_+/.-"):
        return EQUALS if "=" in token else COLON if ":" in token else QUOTE if token[0] in "\"'`" else MARK
    if _KEYWORD.search(token):
        return KEYWORD
    core = token.strip(".-+/")
    if core.replace(".", "").replace("-", "").isdigit():
        return NUMBER
    digits = sum(c.isdigit() for c in core)
    return ODD if digits and len(core) >= 8 and any(c.isalpha() for c in core) else PLAIN


def own_features(token: str) -> list[int]:
    """Active features of a token's shape."""
    core = token.rstrip(".")
    n = len(core)
    digits = sum(c.isdigit() for c in core)
    upper, lower = sum("A" <= c <= "Z" for c in core), sum("a" <= c <= "z" for c in core)
    at = len(_LENGTHS)
    on = [sum(n >= x for x in _LENGTHS) - 1] if n else []
    changes = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(core, core[1:]))
    for i, hit in enumerate((
            digits > 0, n > 0 and digits >= 0.2 * n, n > 0 and digits >= 0.6 * n, n > 0 and digits == n,
            n >= 8 and digits > 0 and _HEX.fullmatch(core) is not None, upper > 0 and lower > 0 and digits > 0,
            upper > 1 and lower == 0, lower == n, any(c in "+/_" for c in core), n >= 12 and changes >= n / 4,
            n >= 16 and digits > 0 and len(set(core)) >= 10, not core.isascii(), "." in core or "-" in core,
            not token[0].isalnum())):
        if hit:
            on.append(at + i)
    return on


def file_features(classes: np.ndarray) -> list[int]:
    """Bins of how often a file assigns, and of how many of its tokens look odd."""
    n = max(len(classes), 1)
    count = np.bincount(classes, minlength=N_CLASSES)
    assigns, odd = (count[EQUALS] + count[COLON]) / n, (count[ODD] + count[NUMBER]) / n
    return [int(np.searchsorted((0.005, 0.05), assigns)), 3 + int(np.searchsorted((0.01, 0.1), odd))]


# --- the model ------------------------------------------------------------

OUT, BEGIN, IN = range(3)


@dataclass
class Crf:
    own: np.ndarray       # (N_OWN, 3)
    near: np.ndarray      # (len(NEAR), N_CLASSES, 3)
    words: np.ndarray     # (known words + 1, 3) for the word before
    file: np.ndarray      # (N_FILE, 3)
    move: np.ndarray      # (3, 3) transitions
    known: dict[str, int]

    def slack(self) -> float:
        """The most that transitions can favour another state over outside, at one token."""
        m = self.move
        return max(m[a, s] + m[s, b] - m[a, OUT] - m[OUT, b]
                   for a in range(3) for b in range(3) for s in (BEGIN, IN))


def _viterbi(emit: np.ndarray, move: np.ndarray) -> list[int]:
    """Best states of a stretch that has outside on both sides."""
    best, back = move[OUT] + emit[0], []
    for e in emit[1:]:
        step = best[:, None] + move
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + e
    state = int((best + move[:, OUT]).argmax())
    states = [state]
    for b in reversed(back):
        state = int(b[state])
        states.append(state)
    return states[::-1]


class Tagger:
    """Decodes whole texts; scored tokens are cached within a bound."""

    def __init__(self, model: Crf):
        self.model = model
        # the most that each part can favour another state over outside
        gain = lambda w: (w[..., 1:].max(axis=-1) - w[..., OUT]).astype(np.float32)
        self.near_gain = [gain(n) for n in model.near]
        self.word_gain = gain(model.words)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}        # token to entry
        self.shapes: dict[tuple, int] = {}     # words of letters that score alike share one
        self.n = 0
        self.own = np.zeros((1 << 10, 3))
        self.kind = np.full(1 << 10, EDGE, dtype=np.int8)
        self.word = np.zeros(1 << 10, dtype=np.int32)
        self.gain = np.zeros(1 << 10, dtype=np.float32)

    def _add(self, token: str) -> None:
        core = token.rstrip(".")
        word = self.model.known.get(token.lower(), 0)
        shape = None
        if core.isalpha() and (core[1:].islower() or len(core) == 1):
            shape = len(core), core[0].isupper(), core.isascii(), _KEYWORD.search(core) is None, word
            if shape in self.shapes:
                self.index[token] = self.shapes[shape]
                return
            self.shapes[shape] = self.n
        i = self.n
        if i == len(self.own):
            self.own, self.kind, self.word, self.gain = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.own, self.kind, self.word, self.gain))
        self.index[token] = i
        self.n += 1
        own = self.model.own[own_features(token)].sum(axis=0)
        self.own[i], self.gain[i] = own, own[1:].max() - own[OUT]
        self.kind[i] = token_class.__wrapped__(core if shape else token)
        self.word[i] = word

    def spans(self, text: str) -> list[tuple[int, int]]:
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        if len(self.index) > CACHED_TOKENS:
            self._clear()
        get = self.index.get
        ids = [get(t, -1) for t in tokens]
        if -1 in ids:
            for t, i in zip(tokens, ids):
                if i < 0 and t not in self.index:
                    self._add(t)
            ids = [self.index[t] for t in tokens]
        ids = np.array(ids)
        m, pad = self.model, (-min(NEAR), max(NEAR))
        around = np.full(len(ids) + sum(pad), EDGE, dtype=np.int8)
        around[pad[0]: pad[0] + len(ids)] = kinds = self.kind[ids]
        words = np.zeros(len(ids), dtype=np.int32)
        words[1:] = self.word[ids[:-1]]
        file = m.file[file_features(kinds)].sum(axis=0)
        most = self.gain[ids] + self.word_gain[words]
        for k, d in enumerate(NEAR):
            most += self.near_gain[k][around[pad[0] + d: pad[0] + d + len(ids)]]
        maybe = np.flatnonzero(most > -(file[1:].max() - file[OUT]) - m.slack() - 1e-3)
        if not len(maybe):
            return []
        emit = self.own[ids[maybe]] + m.words[words[maybe]] + file
        for k, d in enumerate(NEAR):
            emit = emit + m.near[k][around[maybe + d + pad[0]]]
        found, i = [], 0
        while i < len(maybe):
            j = i + 1
            while j < len(maybe) and maybe[j] == maybe[j - 1] + 1:
                j += 1
            states = _viterbi(emit[i:j], self.model.move)
            before = OUT
            for k, s in enumerate(states):
                if s == BEGIN or s == IN and before == OUT:
                    found.append([maybe[i + k], maybe[i + k] + 1])
                elif s == IN:
                    found[-1][1] += 1
                before = s
            i = j
        if not found:
            return []
        at = [m.span() for m in TOKEN.finditer(text)]
        return [(at[a][0], at[b - 1][0] + max(1, len(tokens[b - 1].rstrip(".")))) for a, b in found]


def scan(text: str | None, tagger: Tagger | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind (``crf`` last)."""
    if not text:
        return []
    base = [s[:3] for s in base_spans(text)]
    if tagger is None:
        return base
    more = [("crf", a, b) for a, b in tagger.spans(text) if not any(a < e and s < b for _, s, e in base)]
    order = (*KINDS, "crf")
    return sorted(base + more, key=lambda s: (s[1], order.index(s[0])))


# --- training ---------------------------------------------------------------

def _windows(text: str, sorts: tuple[int, ...] = (0, 1)):
    """Token windows of a text: ``(sort, middle, tokens, states, file bins)``; sort 1 holds a secret."""
    spans = base_spans(text)
    if not spans and 0 not in sorts:
        return
    at = [m.span() for m in TOKEN.finditer(text)]
    if not at:
        return
    tokens = [text[a:b] for a, b in at]
    states = [OUT] * len(at)
    starts = [a for a, _ in at]
    middles = {0: [], 1: []}
    for _, _, end, secret in spans:
        lo, hi = np.searchsorted(starts, secret), np.searchsorted(starts, end)
        for i in range(lo, hi):
            states[i] = BEGIN if i == lo else IN
        if hi > lo:
            middles[1].append(lo)
    classes = np.array([token_class(t) for t in tokens])
    odd = [i for i in np.flatnonzero((classes == ODD) | (classes == NUMBER) | (classes == KEYWORD)).tolist() if states[i] == OUT]
    middles[0] = odd[:: max(1, len(odd) // 4)] + [len(tokens) // 2] * (states[len(tokens) // 2] == OUT)
    bins = file_features(classes)
    for sort in sorts:
        for i in middles[sort]:
            lo, hi = max(0, i - AROUND), min(len(tokens), i + AROUND + 1)
            yield sort, i, tokens[lo:hi], states[lo:hi], bins


def sample_windows(docs: DataFrame, text_col: str, sample_docs: int = SAMPLE_DOCS, windows: int = WINDOWS) -> list:
    """At most ``windows`` windows of each sort: with a secret, of all documents; without, of about
    ``sample_docs`` different texts chosen by hash.  Copies of a text count once.

    Windows are chosen by their narrow keys (text hash, place); the texts chosen are read again."""
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).filter("text is not null")
    share = min(1.0, sample_docs / max(1, texts.agg(F.approx_count_distinct("h")).first()[0]))
    sampled = F.pmod(F.col("h"), F.lit(1 << 20)) < share * (1 << 20)
    looked = texts.withColumn("sampled", sampled).filter(F.col("sampled") | F.col("text").rlike(MAY_HOLD))

    def keys(batches):
        seen: set[int] = set()
        for batch in batches:
            found = []
            for text, h, both in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if h in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(h)
                found += [(w[0], h, w[1]) for w in _windows(text.as_py(), (0, 1) if both else (1,))]
            columns = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32()))],
                                             ["sort", "h", "i"])

    found = stage(looked.mapInArrow(keys, "sort int, h long, i int").distinct(), "secret-windows")
    order = [F.xxhash64("h", "i"), F.col("h"), F.col("i")]
    parts = [found.filter(F.col("sort") == s).orderBy(*order).limit(windows) for s in (0, 1)]
    chosen: dict[int, set] = {}
    for r in parts[0].union(parts[1]).collect():
        chosen.setdefault(r["h"], set()).add((r["sort"], r["i"]))
    wanted = docs.sparkSession.createDataFrame([(h,) for h in chosen], "h long")

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            rows = [[] for _ in range(6)]
            for text, h in zip(batch.column(0), batch.column(1).to_pylist()):
                if h in seen:
                    continue
                seen.add(h)
                for sort, i, tokens, states, bins in _windows(text.as_py()):
                    if (sort, i) in chosen[h]:
                        for c, v in zip(rows, (sort, h, i, tokens, states, bins)):
                            c.append(v)
            types = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)],
                                             ["sort", "h", "i", "tokens", "states", "bins"])

    out = texts.join(F.broadcast(wanted), "h", "left_semi").select("text", "h") \
               .mapInArrow(run, "sort int, h long, i int, tokens array<string>, states array<int>, bins array<int>")
    return sorted(out.distinct().collect(), key=lambda r: (r["sort"], r["h"], r["i"]))


def fit(rows: list, rounds: int = 90, decay: float = 5e-4) -> Crf | None:
    """Maximum likelihood by Adam, all windows at once; None without a positive one."""
    rows = list({(tuple(r["tokens"]), tuple(r["states"])): r for r in rows if r["tokens"]}.values())   # copies count once
    if not any(r["sort"] == 1 for r in rows):
        return None
    before: dict[str, int] = {}
    for r in rows:
        for t, s in zip(r["tokens"], r["states"][1:]):
            if s == BEGIN:
                before[t.lower()] = before.get(t.lower(), 0) + 1
    often = sorted((w for w, n in before.items() if n >= 5), key=lambda w: (-before[w], w))[:200]
    known = {w: i + 1 for i, w in enumerate(often)}
    steps = max(len(r["tokens"]) for r in rows)
    pad_l, pad_r = -min(NEAR), max(NEAR)
    own = np.zeros((len(rows), steps, N_OWN), dtype=np.float32)
    kinds = np.full((len(rows), steps + pad_l + pad_r), EDGE)
    word = np.zeros((len(rows), steps), dtype=int)
    gold = np.zeros((len(rows), steps), dtype=int)
    mask = np.zeros((len(rows), steps), dtype=bool)
    files = np.zeros((len(rows), N_FILE), dtype=np.float32)
    for i, r in enumerate(rows):
        n = len(r["tokens"])
        mask[i, :n], gold[i, :n] = True, r["states"]
        files[i, r["bins"]] = 1
        for j, t in enumerate(r["tokens"]):
            own[i, j, own_features(t)] = 1
            kinds[i, j + pad_l] = token_class(t)
            if j + 1 < n:
                word[i, j + 1] = known.get(t.lower(), 0)
    near = [kinds[:, pad_l + d: pad_l + d + steps] for d in NEAR]
    params = [np.zeros((N_OWN, 3)), np.zeros((len(NEAR), N_CLASSES, 3)), np.zeros((len(known) + 1, 3)),
              np.zeros((N_FILE, 3)), np.zeros((3, 3))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    one = np.eye(3)[gold] * mask[..., None]
    for step in range(1, rounds + 1):
        w_own, w_near, w_word, w_file, move = params
        emit = own @ w_own + w_word[word] + (files @ w_file)[:, None]
        for k in range(len(NEAR)):
            emit = emit + w_near[k][near[k]]
        miss, moves = _marginals(emit * mask[..., None], move, mask)
        d = (miss - one) / len(rows)
        grads = [np.einsum("nto,nts->os", own, d),
                 np.stack([_summed(x, d, N_CLASSES) for x in near]), _summed(word, d, len(known) + 1),
                 files.T @ d.sum(axis=1)]
        both = mask[:, 1:] & mask[:, :-1]
        seen = np.zeros((3, 3))
        np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        seen[OUT] += np.bincount(gold[:, 0], minlength=3)
        grads.append((moves - seen) / len(rows))
        for p, g, m, v in zip(params, grads, first, second):
            g = g + decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Crf(*params[:4], params[4], known)


def _summed(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index.ravel(), values[..., s].ravel(), minlength=n) for s in range(3)], axis=1)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _marginals(emit: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State marginals and summed transition marginals of windows, by forward and backward sums."""
    n, steps, _ = emit.shape
    fore, back = np.zeros_like(emit), np.zeros_like(emit)
    fore[:, 0] = move[OUT] + emit[:, 0]
    for t in range(1, steps):
        new = _lse(fore[:, t - 1, :, None] + move, axis=1) + emit[:, t]
        fore[:, t] = np.where(mask[:, t, None], new, fore[:, t - 1])
    total = _lse(fore[:, -1], axis=1)[:, None]
    for t in range(steps - 2, -1, -1):
        new = _lse(move + (emit[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
        back[:, t] = np.where(mask[:, t + 1, None], new, 0)
    states = np.exp(fore + back - total[:, None]) * mask[..., None]
    moves = np.zeros((3, 3))
    moves[OUT] += states[:, 0].sum(axis=0)
    for t in range(1, steps):
        pair = fore[:, t - 1, :, None] + move + (emit[:, t] + back[:, t])[:, None, :] - total[:, :, None]
        moves += (np.exp(pair) * mask[:, t, None, None]).sum(axis=0)
    return states, moves


def train(docs: DataFrame, text_col: str = "text") -> Crf | None:
    return fit(sample_windows(docs, text_col))


# --- columns ------------------------------------------------------------------

def spans(text: Column | str, model: Crf | None) -> Column:
    """All spans of every text: an array of ``kind, start, end`` in code points."""

    @F.arrow_udf(SPAN_TYPE)
    def udf(column: pa.Array) -> pa.Array:
        tagger = Tagger(model) if model else None
        out = [[{"kind": k, "start": int(a), "end": int(b)} for k, a, b in scan(t.as_py(), tagger)] for t in column]
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return udf(F.col(text) if isinstance(text, str) else text)


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_text(text: str | None, found: list[tuple[str, int, int]], mark: str) -> str | None:
    out, at = [], 0
    for _, a, b in found:
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]]) if at else text


def redacted(text: Column | str, model: Crf | None, mark: str = "[SECRET]") -> Column:
    """Each text with every span (overlapping ones together) replaced by ``mark``."""

    @F.arrow_udf("string")
    def udf(column: pa.Array) -> pa.Array:
        tagger = Tagger(model) if model else None
        texts = (t.as_py() for t in column)
        return pa.array([redact_text(t, scan(t, tagger), mark) for t in texts], pa.string())

    return udf(F.col(text) if isinstance(text, str) else text)

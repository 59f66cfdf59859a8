"""Personal data: exact patterns, and a character BiLSTM with a CRF for what they miss.

The network reads windows of characters; its CRF layer scores whole tag sequences (begin and inside
tags of four kinds), so a span is decoded as a whole. It is trained here, in numpy, from labelled
spans: texts of invented words with addresses, numbers and look-alikes (versions, dates, keys) set
among them, whose places are known. Every kind of span holds a digit or an `@`, so windows are laid,
overlapping, over all places near one; text far from any decodes to no span by that rule and is not
read by the network. Where windows overlap, each character takes the tag from the window in which it
lies deepest; spans are then read from the joined tags, so one may run across windows.

A decoded span counts if it is plausible for its kind and doesn't overlap a pattern's span.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, read_table, released, remembered, tune, with_columns

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # 0 outside; 1 + 2k begins kind k, 2 + 2k goes on
WINDOW, STEP, NEAR = 96, 48, 40
EMBED, HIDDEN = 12, 20
PAD, OTHER, CHARS = 0, 128, 129

_TRIGGER = re.compile("[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where its run of digits does, so none is tried inside a run
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    """Whether digits, however many, are a number of 255 at most."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by start and then kind; offsets in code points."""
    if not _TRIGGER.search(text):
        return []
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(_small(p) for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return by_place(found)


def by_place(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def plausible(kind: str, s: str) -> bool:
    """Whether a decoded span could be of its kind at all: the right number of digits, or parts around an `@`.

    The network decides what a span is; this only drops what can't be one.
    """
    d = _digits(s)
    if kind == "email":
        local, at, domain = s.partition("@")
        return bool(at and local.strip() and "." in domain.strip(" .\n") and "@" not in domain)
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(_small(p) for p in parts)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d) and len(set(d)) > 2
    return 9 <= len(d) <= 15 and len(set(d)) > 2


# -- training texts ---------------------------------------------------------------------------


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng: np.random.Generator) -> str:
    body = str(rng.integers(3, 7)) + _number(rng, int(rng.integers(13, 16)) - 1)
    digits = next(body + str(k) for k in range(10) if luhn(body + str(k)))
    sep = ["", "", " ", "-", "\n", "."][rng.integers(6)]
    if sep == "\n":
        cut = int(rng.integers(4, len(digits) - 3))
        return digits[:cut] + sep + digits[cut:]
    return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _phone(rng: np.random.Generator) -> str:
    a, b, c, d = _number(rng, 3), _number(rng, 3), _number(rng, 4), str(rng.integers(1, 99))
    return [f"+{d} ({a}) {b}-{c}", f"+{d} {a} {b} {c}", f"+{d}{a}{b}{c}", f"+{d}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{d} {a}\n{b} {c}", f"00{d} {a} {b} {c}"][rng.integers(8)]


def _word(rng: np.random.Generator, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    return "".join(rng.choice(list(letters), int(rng.integers(1, 10))))


def _email(rng: np.random.Generator) -> str:
    local = _word(rng) + ["", ".", "_", "+", "-"][rng.integers(5)] + [_word(rng), _number(rng, 2)][rng.integers(2)]
    at = ["@", "@", "@", " @ ", "@\n"][rng.integers(5)]
    return local + at + ".".join(_word(rng) for _ in range(rng.integers(1, 3))) + [".com", ".org", ".net", ".de", ".io", ".example.com"][rng.integers(6)]


def _ip(rng: np.random.Generator) -> str:
    return ["." , ".", ".", ".\n", ". "][rng.integers(5)].join(map(str, rng.integers(0, 256, 4)))


def _look_alike(rng: np.random.Generator) -> str:
    h = "".join(rng.choice(list("0123456789abcdef"), 16))
    return [
        f"{rng.integers(1, 9)}.{rng.integers(0, 20)}", f"version {rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 99)}", f"{rng.integers(1900, 2030)}",
        f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 31)}", f"{rng.integers(1, 24)}:{rng.integers(10, 60)}", f"${rng.integers(1, 999)},{_number(rng, 3)}.{_number(rng, 2)}",
        _number(rng, int(rng.integers(1, 12))), f"password={h}", f'token = "{h}"', "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16)), f"@{_word(rng)}", f"#{_number(rng, 5)}",
        f"{rng.integers(256, 999)}.{rng.integers(0, 256)}.{rng.integers(256, 999)}.{rng.integers(0, 256)}", f"{_number(rng, 2)}%", f"| {_number(rng, 4)} | {_number(rng, 6)} |",
    ][rng.integers(15)]


def sample(rng: np.random.Generator, length: int = WINDOW) -> tuple[str, np.ndarray]:
    """An invented text and its tags."""
    make, text, tags = (_email, _ip, _card, _phone), "", []
    letters = ["abcdefghijklmnopqrstuvwxyz", "abcdeéèêçaiourtnslm", "abdeintzüöäßchrsg", "aeiouñóíscrtldn"][rng.integers(4)]
    while len(text) < length:
        pick = rng.random()
        if pick < 0.22:
            k = int(rng.integers(4))
            s = make[k](rng)
            t = [1 + 2 * k] + [2 + 2 * k] * (len(s) - 1)
        elif pick < 0.4:
            s = _look_alike(rng)
            t = [0] * len(s)
        else:
            s = _word(rng, letters)
            s = s.capitalize() if rng.random() < 0.15 else s
            t = [0] * len(s)
        end = [" ", " ", " ", ", ", ". ", ".\n", "\n"][rng.integers(7)]
        text, tags = text + s + end, [*tags, *t, *[0] * len(end)]
    start = int(rng.integers(0, len(text) - length + 1))
    return text[start : start + length], np.array(tags[start : start + length])


# -- network ----------------------------------------------------------------------------------


def encode(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(a < 128, np.maximum(a, 1), OTHER).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


#: Transitions into an inside tag from anything but its own kind are barred.
_BARRED = np.array([[j > 0 and j % 2 == 0 and i not in (j - 1, j) for j in range(TAGS)] for i in range(TAGS)]) * -1e4
_FIRST = np.zeros(TAGS)  # a window may begin inside a span


@dataclass
class Network:
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        h, e = HIDDEN, EMBED
        p = {"E": rng.normal(0, 0.3, (CHARS, e)), "O": rng.normal(0, 0.2, (2 * h, TAGS)), "o": np.zeros(TAGS), "A": np.zeros((TAGS, TAGS))}
        for d in "fb":
            p |= {f"X{d}": rng.normal(0, e**-0.5, (e, 4 * h)), f"H{d}": rng.normal(0, h**-0.5, (h, 4 * h)), f"c{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Over time-major x; for direction b the caller has reversed it. Gates are kept for gradients only: they take most of the memory."""
        n, h = x.shape[1], HIDDEN
        pre = x @ self.p[f"X{d}"] + self.p[f"c{d}"]
        s, c, out, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), [], []
        for z in pre:
            z = z + s @ self.p[f"H{d}"]
            ifo = _sigmoid(z[:, : 3 * h])
            i, f, o, g = ifo[:, :h], ifo[:, h : 2 * h], ifo[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, c_old = s, c
            c = f * c + i * g
            tc = np.tanh(c)
            s = o * tc
            out.append(s)
            if keep:
                kept.append((i, f, o, g, c_old, tc, before))
        return np.stack(out), kept

    def emissions(self, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Tag scores (time, batch, tag) of windows (batch, time); with keep also what gradients need."""
        x = self.p["E"][ids.T]
        f, kf = self._lstm(x, "f", keep)
        b, kb = self._lstm(x[::-1], "b", keep)
        s = np.concatenate([f, b[::-1]], axis=2)
        return s @ self.p["O"] + self.p["o"], (x, s, kf, kb)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window, (batch, time)."""
        em = self.emissions(ids)[0]
        trans = self.p["A"] + _BARRED
        best, back = em[0] + _FIRST, []
        for e in em[1:]:
            s = best[:, :, None] + trans
            back.append(s.argmax(1))
            best = s.max(1) + e
        tags = [best.argmax(1)]
        for b in reversed(back):
            tags.append(b[np.arange(len(b)), tags[-1]])
        return np.stack(tags[::-1], axis=1)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        em, (x, s, kf, kb) = self.emissions(ids, keep=True)
        t, n, k = em.shape
        em, trans = em.astype(np.float64), self.p["A"].astype(np.float64) + _BARRED
        alpha = [em[0] + _FIRST]
        for e in em[1:]:
            alpha.append(_lse(alpha[-1][:, :, None] + trans, 1) + e)
        beta = [np.zeros((n, k))]
        for e in em[:0:-1]:
            beta.append(_lse(trans + (e + beta[-1])[:, None, :], 2))
        beta = beta[::-1]
        z = _lse(alpha[-1], 1)
        de = np.exp(np.stack(alpha) + np.stack(beta) - z[:, None])
        da = np.zeros((k, k))
        for i in range(t - 1):
            da += np.exp(alpha[i][:, :, None] + trans + (em[i + 1] + beta[i + 1])[:, None, :] - z[:, None, None]).sum(0)
        gold = tags.T
        rows = np.arange(n)
        score = sum(em[i, rows, gold[i]].sum() for i in range(t)) + trans[gold[:-1], gold[1:]].sum()
        de[np.arange(t)[:, None], rows, gold] -= 1
        np.add.at(da, (gold[:-1].ravel(), gold[1:].ravel()), -1)
        de = (de / n).astype(np.float32)
        g = {"A": (da / n).astype(np.float32), "o": de.sum((0, 1)), "O": np.einsum("tnh,tnk->hk", s, de)}
        ds = de @ self.p["O"].T
        dxf = self._back(x, kf, ds[:, :, :HIDDEN], "f", g)
        dxb = self._back(x[::-1], kb, ds[::-1, :, HIDDEN:], "b", g)
        dx = dxf + dxb[::-1]
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], ids.T.ravel(), dx.reshape(-1, EMBED))
        return float((z.sum() - score) / n), g

    def _back(self, x: np.ndarray, kept: list, ds: np.ndarray, d: str, g: dict[str, np.ndarray]) -> np.ndarray:
        w = self.p[f"H{d}"]
        dz = np.empty((*ds.shape[:2], 4 * HIDDEN), np.float32)
        dh, dc = np.zeros_like(ds[0]), np.zeros_like(ds[0])
        gw = np.zeros_like(w)
        for t in range(len(kept) - 1, -1, -1):
            i, f, o, c, c_old, tc, before = kept[t]
            dh = dh + ds[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * c * i * (1 - i), dc * c_old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - c * c)], axis=1)
            gw += before.T @ dz[t]
            dh = dz[t] @ w.T
            dc = dc * f
        g[f"H{d}"], g[f"c{d}"] = gw, dz.sum((0, 1))
        g[f"X{d}"] = np.einsum("tne,tnh->eh", x, dz)
        return dz @ self.p[f"X{d}"].T


def train(rounds: int = 700, batch: int = 32, rate: float = 0.012, seed: int = 11) -> Network:
    """Adam on fresh invented windows each round; the same network every time."""
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in "mv")
    for r in range(1, rounds + 1):
        made = [sample(rng, 64) for _ in range(batch)]
        _, g = net.gradients(np.stack([encode(s) for s, _ in made]), np.stack([t for _, t in made]))
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        now = rate * min(1, r / 20) * (1 - 0.95 * r / rounds)
        for k, x in g.items():
            x = x * min(1, 5 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.999 * v[k] + 0.001 * x * x
            net.p[k] -= (now * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.999**r)) + 1e-8)).astype(np.float32)
    return net


_trained: list[Network] = []


def network(spark: SparkSession | None = None) -> Network:
    """The trained network: trained once, and kept in the shared folder for other sessions."""
    if not _trained:
        _trained.append(train() if spark is None else loaded(remembered(spark, f"pii-{_recipe()}", lambda: saved(train()))))
    return _trained[0]


def _recipe() -> str:
    """Names what the weights depend on: this module's text and numpy."""
    with open(__file__, "rb") as f:
        return hashlib.sha256(f.read() + np.__version__.encode()).hexdigest()[:16]


def saved(net: Network) -> bytes:
    out = io.BytesIO()
    np.savez(out, **net.p)
    return out.getvalue()


def loaded(data: bytes) -> Network:
    with np.load(io.BytesIO(data)) as z:
        return Network({k: z[k] for k in z.files})


# -- spans of whole texts ---------------------------------------------------------------------


def windows(text: str) -> list[int]:
    """Where windows start: laid over all stretches within NEAR characters of a digit or `@`."""
    starts, lo, hi = [], -1, -1
    stretches = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - NEAR), min(len(text), m.end() + NEAR)
        if a <= hi:
            hi = b
        else:
            if hi > 0:
                stretches.append((lo, hi))
            lo, hi = a, b
    if hi > 0:
        stretches.append((lo, hi))
    for lo, hi in stretches:
        at = lo
        while True:
            starts.append(at)
            if at + WINDOW >= hi:
                break
            at += STEP
    return starts


def decoded_spans(texts: list[str], net: Network, batch: int = 512) -> list[list[tuple[str, int, int]]]:
    """The plausible spans that the network reads in each text."""
    jobs = [(i, at) for i, t in enumerate(texts) for at in windows(t)]
    # for each text with windows: how deep the deepest window has each character, and its tag there
    depth = {i: np.full(len(texts[i]), -1, np.int16) for i in {i for i, _ in jobs}}
    tag = {i: np.zeros(len(texts[i]), np.int8) for i in depth}
    places = np.arange(WINDOW, dtype=np.int16)
    for lo in range(0, len(jobs), batch):
        mine = jobs[lo : lo + batch]
        ids = np.zeros((len(mine), WINDOW), np.int64)
        for r, (i, at) in enumerate(mine):
            e = encode(texts[i][at : at + WINDOW])
            ids[r, : len(e)] = e
        for (i, at), row in zip(mine, net.decode(ids), strict=True):
            n = min(WINDOW, len(texts[i]) - at)
            left = places[:n] if at else np.full(n, WINDOW, np.int16)
            right = n - 1 - places[:n] if at + n < len(texts[i]) else np.full(n, WINDOW, np.int16)
            deep = np.minimum(left, right)
            better = deep > depth[i][at : at + n]
            depth[i][at : at + n][better] = deep[better]
            tag[i][at : at + n][better] = row[:n][better]
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, tags in tag.items():
        start = kind = None
        last = -2
        for at in [*np.flatnonzero(tags).tolist(), len(texts[i]) + 2]:
            t = int(tags[at]) if at < len(tags) else 0
            goes_on = start is not None and at == last + 1 and t == 2 + 2 * kind
            if start is not None and not goes_on:
                if plausible(KINDS[kind], texts[i][start : last + 1]):
                    found[i].append((KINDS[kind], start, last + 1))
                start = None
            if start is None and t:
                start, kind = at, (t - 1) // 2
            last = at
    return found


def find_spans(texts: list[str], net: Network) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(pattern spans, added spans) of each text."""
    base = [pattern_spans(t) for t in texts]
    added = []
    for b, d in zip(base, decoded_spans(texts, net), strict=True):
        added.append([s for s in d if all(s[2] <= x[1] or s[1] >= x[2] for x in b)])
    return list(zip(base, added, strict=True))


_KIND = pa.struct([("base", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), ("added", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def detect(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with struct(base, added) in `out`: arrays of struct(kind, start, end), ordered by place.

    Offsets count code points, end exclusive. Null counts as empty; a text without a digit or `@` has
    no spans. Whole texts are read however long; every row and column is kept, repeated rows too; an empty
    table stays empty; a column `out` of docs, in any case of letters, is replaced.
    """
    tune(docs.sparkSession)
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(network(docs.sparkSession))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            rows = [{n: [{"kind": k, "start": s, "end": e} for k, s, e in x] for n, x in zip(("base", "added"), found, strict=True)} for found in find_spans(texts, shared.value)]
            yield with_columns(b, {out: pa.array(rows, _KIND)})

    return docs.mapInArrow(released(go), arrow_schema(docs, (out, T.StructType.fromDDL(f"base {_SPANS}, added {_SPANS}"))))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in by_place(spans))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = detect(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans):
        order = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("nth"), x["end"].alias("end"), x["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(order), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *(_count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(F.col("pii.base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("pii.base", "pii.added")).alias("spans"),
    )


def _count(kind: str):
    return F.size(F.filter("pii.base", lambda x: x["kind"] == kind)).cast("long")


def _replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with spans, ordered by place, replaced."""
    parts, done = [], 0
    for k, s, e in spans:
        if s >= done:
            parts += [text[done:s], f"<{k.upper()}>"]
        done = max(done, e)
    return "".join(parts) + text[done:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every found span replaced by its kind in capitals and angle brackets.

    Overlapping spans are replaced together, by the kind that starts first. Null texts stay null;
    texts without a span stay as they are, byte by byte. Rows, repeated ones too, columns and their names
    stay; an empty table stays empty.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network(docs.sparkSession))
    at = docs.columns.index(text)

    # found and replaced by one worker: spans that went to a second one would double the workers of an executor
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, (base, added) in enumerate(find_spans([t or "" for t in texts], shared.value)):
                if base or added:
                    texts[i] = _replaced(texts[i], by_place(base + added))
            cols = [pa.array(texts, c.type) if j == at else c for j, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(released(go), docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, repeated rows too, and redacts its personal data; n_chars follows the text, null with it."""
    clean = redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def brute(text: str | None) -> tuple[dict[str, int], str]:
    """Pattern counts and base_sha256 by plain regular expressions."""
    t, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(_small(p) for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 12 <= len(_digits(m[0])) <= 19 and luhn(_digits(m[0])):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return {k: sum(f[0] == k for f in found) for k in KINDS}, hashlib.sha256(joined(found).encode()).hexdigest()

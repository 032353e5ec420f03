"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, labels every position, and a
document's probabilities are the mean over its positions.  Texts run as lanes
of ``WINDOW`` bytes side by side, each from a fresh state, so that any text
takes as many lanes as it needs and none is cut short.  Training is back-
propagation through time in numpy, on a bounded sample (``SAMPLE_ROWS`` labelled
rows with the least hash of doc_id, ``PARTS`` parts at any place of their texts).

Defined results: null text, or text without a letter, is ``und`` with score 0;
without any labelled training row every document is ``und``; equal texts have
equal labels; the label, source and id of a row are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import documents

#: Rows that the network is trained on at most.
SAMPLE_ROWS = 2000
#: Parts of a row's text that are looked at, and their characters.
PARTS, PART = 4, 512
WINDOW = 96
HIDDEN = 6
UNKNOWN = "und"
#: Least probability of no learned language at which a document goes: short texts full of numbers and keys come near a half.
SURELY_UNKNOWN = 0.85


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def has_letter(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


class Network:
    """Arrays are feature by lane.  x: input table by byte, u: recurrent weights, w, b: output layer."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        f = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("x", f(3 * hidden, 256)), ("u", f(3 * hidden, hidden)))}
        self.p |= {"w": f(len(labels), 2 * hidden), "b": np.zeros((len(labels), 1), np.float32)}

    def _run(self, d: str, codes: np.ndarray, valid: np.ndarray, keep: bool):
        """States after every step (T, H, N), in time order; with keep also what the way back needs."""
        x, u, h2 = self.p[f"x{d}"], self.p[f"u{d}"], 2 * self.hidden
        steps, lanes = codes.shape
        states = np.empty((steps, self.hidden, lanes), np.float32)
        h = np.zeros((self.hidden, lanes), np.float32)
        trace = {}
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = np.take(x, codes[t], axis=1)
            s = u @ h
            a[:h2] += s[:h2]
            zr = _sigmoid(a[:h2])
            z, r = zr[: self.hidden], zr[self.hidden :]
            n = a[h2:]
            n += r * s[h2:]
            np.tanh(n, out=n)
            if keep:
                trace[t] = (h, z, r, n, s[h2:])
            h = h - n
            h *= z
            h += n
            if d == "b":
                h *= valid[t]
            states[t] = h
        return states, trace

    def probabilities(self, codes: np.ndarray, valid: np.ndarray, keep: bool = False):
        """(T, C, N) for every position."""
        f, tf = self._run("f", codes, valid, keep)
        b, tb = self._run("b", codes, valid, keep)
        w, k = self.p["w"], self.hidden
        logits = np.matmul(w[:, :k], f)
        logits += np.matmul(w[:, k:], b)
        logits += self.p["b"]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return (logits, f, b, tf, tb) if keep else logits

    def gradients(self, codes: np.ndarray, valid: np.ndarray, target: np.ndarray):
        """Backpropagation through time of the mean cross entropy over valid positions."""
        prob, f, b, tf, tb = self.probabilities(codes, valid, True)
        steps, lanes = codes.shape
        total = valid.sum()
        picked = prob[:, target, np.arange(lanes)]
        loss = float(-(np.log(picked + 1e-9) * valid).sum() / total)
        dl = prob
        dl[:, target, np.arange(lanes)] -= 1
        dl *= valid[:, None] / total
        k = self.hidden
        g = {"w": np.concatenate([np.einsum("tcn,thn->ch", dl, s) for s in (f, b)], 1), "b": dl.sum((0, 2))[:, None]}
        for d, trace, part in (("f", tf, self.p["w"][:, :k]), ("b", tb, self.p["w"][:, k:])):
            u = self.p[f"u{d}"]
            back = np.einsum("ch,tcn->thn", part, dl)
            du, da = np.zeros_like(u), np.empty((steps, 3 * k, lanes), np.float32)
            dh = np.zeros((k, lanes), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, z, r, n, sn = trace[t]
                dh = dh + back[t]
                if d == "b":
                    dh *= valid[t]
                dan = dh * (1 - z) * (1 - n * n)
                daz = dh * (h - n) * z * (1 - z)
                dar = dan * sn * r * (1 - r)
                ds = np.concatenate((daz, dar, dan * r))
                da[t] = np.concatenate((daz, dar, dan))
                dh = dh * z + u.T @ ds
                du += ds @ h.T
            flat = codes.ravel()
            g[f"u{d}"] = du
            g[f"x{d}"] = np.stack([np.bincount(flat, da[:, j].ravel(), 256) for j in range(3 * k)]).astype(np.float32)
        return loss, g

    def fit(self, texts: list[bytes], labels: list[str], steps: int = 400, lanes: int = 256, window: int = 48, rate: float = 0.03, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        by = [[t for t, x in zip(texts, labels) if x == label and t] for label in self.labels]
        odds = [np.array([len(t) for t in own], float) ** 0.5 for own in by]
        odds = [o / o.sum() for o in odds]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            target = rng.integers(0, len(by), lanes)
            codes, valid = np.zeros((lanes, window), np.uint8), np.zeros((lanes, window), np.float32)
            for i, c in enumerate(target):
                text = by[c][rng.choice(len(by[c]), p=odds[c])]
                a = int(rng.integers(0, max(len(text) - window // 2, 1)))
                part = text[a : a + window]
                codes[i, : len(part)] = np.frombuffer(part, np.uint8)
                valid[i, : len(part)] = 1
            _, g = self.gradients(np.ascontiguousarray(codes.T), np.ascontiguousarray(valid.T), target)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            speed = rate * (1 - step / (steps + 1)) ** 0.5
            for k, x in g.items():
                x = x * min(1, 1 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] -= (speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def documents(self, texts: list[bytes], window: int = WINDOW, most: int = 8192) -> np.ndarray:
        """Mean probabilities (documents, C) over all positions; texts are not empty."""
        sizes = np.array([len(t) for t in texts], np.int64)
        lanes = -(-sizes // window)
        flat = np.zeros(int(lanes.sum()) * window, np.uint8)
        left = np.full(int(lanes.sum()), window, np.int64)
        ends = np.cumsum(lanes)
        for t, e, k in zip(texts, ends.tolist(), lanes.tolist()):
            a = (e - k) * window
            flat[a : a + len(t)] = np.frombuffer(t, np.uint8)
        left[ends - 1] = sizes - (lanes - 1) * window
        codes = flat.reshape(-1, window)
        sums = np.empty((len(codes), len(self.labels)))
        for a in range(0, len(codes), most):
            part, own = np.ascontiguousarray(codes[a : a + most].T), left[a : a + most]
            valid = (np.arange(window)[:, None] < own).astype(np.float32)
            sums[a : a + most] = np.einsum("tcn,tn->nc", self.probabilities(part, valid), valid)
        return np.add.reduceat(sums, ends - lanes, axis=0) / sizes[:, None]


#: First and last letters of scripts of which text in no learned language is made.
SCRIPTS = [(0xC0, 0xFF), (0x100, 0x17F), (0x391, 0x3C9), (0x410, 0x44F), (0x561, 0x586), (0x5D0, 0x5EA), (0x621, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
SIGNS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef"]


def foreign(texts: list[str], each: int = 40, seed: int = 5) -> list[str]:
    """Random letters: encodings, noise, and scripts that are under a hundredth of the letters of the texts."""
    rng = np.random.default_rng(seed)
    points = np.concatenate([np.frombuffer(t[:5000].encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts])
    letters = points[(points >= 0x41) & ((points >= 0xC0) | np.isin(points & ~np.uint32(32), np.arange(0x41, 0x5B)))]
    share = lambda a, b: ((letters >= a) & (letters <= b)).sum() / max(len(letters), 1)
    pools = [*SIGNS, *("".join(map(chr, range(a, b + 1))) for a, b in SCRIPTS if share(a, b) < 0.01), "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))]
    out = []
    for pool in pools:
        signs = np.array(list(pool))
        for k in range(each):
            text = "".join(rng.choice(signs, 300))
            if k % 2:  # in words
                cuts = np.cumsum(rng.integers(2, 11, 60))
                text = " ".join(text[a:b] for a, b in zip([0, *cuts], cuts) if a < len(text))
            out.append(text)
    return out


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", other: bool = False) -> Network | None:
    """A network fitted on parts of at most ``rows`` labelled rows (twice as many if doc_ids are shared) that are not held out; None without any.

    With ``other`` one more label, ``und``, is learned from ``foreign`` text.
    """
    order = F.xxhash64(id_col)
    known = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col) & has_letter(text_col))
    ids = docs.where(F.col(label_col).isNotNull() & ~held_out(id_col)).select(order.alias("h")).distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if ids is None:
        return None
    # parts of the texts are cut where the texts are; which ones depends on the row alone
    last = F.greatest(F.length(text_col) - PART + 1, F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.substring(F.col(text_col), (F.pmod(F.xxhash64(F.col(id_col), k), last) + 1).cast("int"), F.lit(PART)))
    sample = known.where(order <= ids).select(order.alias("h"), F.col(label_col).alias("label"), F.array_distinct(parts).alias("parts"))
    sample = sample.orderBy("h", "label", "parts").limit(2 * rows).collect()
    texts, own = [], []
    for r in sample:
        some = [p for p in r["parts"] if p]
        texts += some
        own += [r["label"]] * len(some)
    if not texts:
        return None
    if other:
        more = foreign(texts)
        texts, own = texts + more, own + [UNKNOWN] * len(more)
    return Network(sorted(set(own))).fit([t.encode() for t in texts], own)


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.when(has_letter(text_col), F.col(text_col)).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand numbers

    def run(batches):
        network = sent.value
        for whole in batches:
            for b in slices(whole, 2, 1 << 20):
                texts = b.column(2).cast(pa.binary()).to_pylist()
                some = [k for k, t in enumerate(texts) if t] if network else []
                label, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if some:
                    p = network.documents([texts[k] for k in some])
                    for k, c, x in zip(some, p.argmax(1).tolist(), p.max(1).tolist()):
                        label[k], score[k] = network.labels[c], min(1.0, round(x, 6))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(label), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, train(docs))


def keep_known(docs: DataFrame, network: Network | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a letter, whose best language scores ``least`` at least and that is not surely in none; no row without a network."""
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        network = sent.value
        for whole in batches:
            for b in slices(whole, at, 1 << 20):
                texts = b.column(at).cast(pa.binary()).to_pylist()
                keep = [False] * len(texts)
                if network:
                    p = network.documents(texts)
                    language = np.array([x != UNKNOWN for x in network.labels])
                    none = p[:, ~language].sum(1)
                    keep = (np.where(language, p, 0).max(1) >= least) & (none < SURELY_UNKNOWN)
                yield b.filter(pa.array(np.asarray(keep, bool)))

    return docs.where(has_letter(text_col)).mapInArrow(run, docs.schema)

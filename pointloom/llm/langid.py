"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released

WINDOW = 128  # bytes that the network reads at once; every byte of a text lies in one window
UNKNOWN = "und"


class BiGRU:
    """Two gated recurrent layers, one in each direction, over one window of bytes; a softmax over the
    languages labels every position from both hidden states."""

    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        h, c = hidden, len(languages)
        init = lambda *s: (rng.standard_normal(s) * 0.4 / np.sqrt(h)).astype(np.float32)
        # of each direction: input rows by byte for update, reset and candidate; recurrent weights of the first two and of the third
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("x", init(256, 3 * h)), ("u", init(h, 2 * h)), ("c", init(h, h)), ("i", np.zeros(3 * h, np.float32)))}
        self.p |= {"o": init(2 * h, c), "q": np.zeros(c, np.float32)}

    def _run(self, codes: np.ndarray, d: str, keep: bool = False):
        """Hidden states (time, batch, hidden) in reading order of direction d; codes is (time, batch)."""
        h, table = self.hidden, self.p[f"x{d}"] + self.p[f"i{d}"]
        u, c = self.p[f"u{d}"], self.p[f"c{d}"]
        table = table.copy()
        table[:, : 2 * h] *= 0.5  # sigmoid(a) = (1 + tanh(a / 2)) / 2
        u = u * np.float32(0.5)
        steps, n = codes.shape
        out, s = np.empty((steps, n, h), np.float32), np.zeros((n, h), np.float32)
        saved = []
        for t in range(steps):
            a = table[codes[t]]
            g = s @ u
            g += a[:, : 2 * h]
            np.tanh(g, out=g)
            g += 1
            g *= np.float32(0.5)
            z, r = g[:, :h], g[:, h:]
            m = (r * s) @ c
            m += a[:, 2 * h :]
            np.tanh(m, out=m)
            if keep:
                saved.append((s, z, r, m))
            new = out[t]
            np.subtract(m, s, out=new)
            new *= z
            new += s
            s = new
        return (out, saved) if keep else out

    def probabilities(self, codes: np.ndarray, block: int = 16) -> np.ndarray:
        """(time, batch, languages) for windows of bytes codes (time, batch)."""
        f, b = self._run(codes, "f"), self._run(codes[::-1], "b")[::-1]
        h = self.hidden
        out = np.empty((*codes.shape, len(self.languages)), np.float32)
        for t in range(0, len(codes), block):
            e = f[t : t + block] @ self.p["o"][:h]
            e += b[t : t + block] @ self.p["o"][h:]
            e += self.p["q"]
            np.clip(e, -30, 30, out=e)
            np.exp(e, out=e)
            e /= e.sum(-1, keepdims=True)
            out[t : t + block] = e
        return out

    def gradients(self, codes: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over all positions and its gradient by backpropagation through time."""
        steps, n = codes.shape
        h, p = self.hidden, self.p
        hidden = {"f": self._run(codes, "f", True), "b": self._run(codes[::-1], "b", True)}
        f, b = hidden["f"][0], hidden["b"][0][::-1]
        both = np.concatenate([f, b], -1)
        e = both @ p["o"] + p["q"]
        e = np.exp(e - e.max(-1, keepdims=True))
        e /= e.sum(-1, keepdims=True)
        loss = -np.log(np.maximum(e[:, np.arange(n), label], 1e-12)).mean()
        e[:, np.arange(n), label] -= 1
        e /= steps * n
        grad = {"o": both.reshape(-1, 2 * h).T @ e.reshape(-1, e.shape[-1]), "q": e.sum((0, 1))}
        into = e @ p["o"].T
        for d, top, order in (("f", into[..., :h], codes), ("b", into[::-1, :, h:], codes[::-1])):
            u, c = p[f"u{d}"], p[f"c{d}"]
            gu, gc, ga = np.zeros_like(u), np.zeros_like(c), np.empty((steps, n, 3 * h), np.float32)
            ds = np.zeros((n, h), np.float32)
            for t in reversed(range(steps)):
                s, z, r, m = hidden[d][1][t]
                ds = ds + top[t]
                da = ga[t]
                dm = ds * z * (1 - m * m)
                da[:, 2 * h :] = dm
                gc += (r * s).T @ dm
                drs = dm @ c.T
                da[:, :h] = ds * (m - s) * z * (1 - z)
                da[:, h : 2 * h] = drs * s * r * (1 - r)
                gu += s.T @ da[:, : 2 * h]
                ds = ds * (1 - z) + drs * r + da[:, : 2 * h] @ u.T
            flat, where = ga.reshape(-1, 3 * h), order.reshape(-1)
            gx = np.stack([np.bincount(where, weights=flat[:, j], minlength=256) for j in range(3 * h)], 1)
            grad |= {f"u{d}": gu, f"c{d}": gc, f"x{d}": gx.astype(np.float32), f"i{d}": flat.sum(0)}
        return float(loss), grad

    def fit(self, codes: np.ndarray, label: np.ndarray, steps: int = 400, batch: int = 192, rate: float = 0.02, seed: int = 7) -> None:
        """Adam on batches of windows codes (windows, time), with label one language index a window."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(codes), min(batch, len(codes)))
            _, grad = self.gradients(np.ascontiguousarray(codes[pick].T), label[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            pace = rate * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, owner, used): every byte of every text in windows of WINDOW bytes, the last of a text
    filled up with zeros; used counts a window's own bytes."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    codes = np.frombuffer(b"".join(t + bytes(-len(t) % WINDOW) for t in texts), np.uint8).reshape(-1, WINDOW)
    return codes, owner, np.minimum(size[owner] - rank * WINDOW, WINDOW)


def predict(model: BiGRU, texts: list[str | None], batch: int = 4096) -> tuple[list[str], np.ndarray]:
    """Language and score (its probability pooled over all bytes) of each whole text."""
    plain = [(t or "").encode("utf-8", "replace") for t in texts]
    codes, owner, used = windows(plain)
    total = np.zeros((len(texts), len(model.languages)))
    for a in range(0, len(codes), batch):
        p = model.probabilities(np.ascontiguousarray(codes[a : a + batch].T))
        n = used[a : a + batch]
        if (short := np.flatnonzero(n < WINDOW)).size:
            p[:, short] *= (np.arange(WINDOW)[:, None] < n[short])[..., None]
        p = p.sum(0, dtype=np.float64)
        for j in range(p.shape[1]):
            total[:, j] += np.bincount(owner[a : a + batch], weights=p[:, j], minlength=len(texts))
    best = total.argmax(1)
    score = total[np.arange(len(texts)), best] / np.maximum(total.sum(1), 1e-12)
    letters = [t is not None and any(map(str.isalpha, t)) for t in texts]
    known = model.languages != [UNKNOWN]
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best, letters)], np.where(letters, score, 0.0) * known


def training_rows(docs: DataFrame, sample: int) -> DataFrame:
    """A bounded sample of labelled rows: of the documents that may be learned from, the `sample` with
    the smallest hash of doc_id. docs has doc_id, text, lang; the hash takes no other column."""
    free = docs.where("text is not null and lang is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    picked = free.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()  # ids alone meet on the driver, `sample` from each task
    return free.join(F.broadcast(picked), "doc_id", "left_semi").select("text", "lang").limit(sample)


def train(docs: DataFrame, sample: int = 1500, per_text: int = 4, hidden: int = 8, steps: int = 400) -> BiGRU:
    """Fits the network on the driver to a bounded sample: `sample` documents (default 1500), and of each
    `per_text` windows spread over its text. Texts repeat languages as the corpus has them; the
    windows are drawn evenly over languages. With no labelled text the model knows no language."""
    rows = training_rows(docs, sample).collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return BiGRU([UNKNOWN], hidden)
    by: dict[str, list[np.ndarray]] = {k: [] for k in languages}
    for r in rows:
        data = r["text"].encode("utf-8", "replace")
        codes, _, used = windows([data])
        full = codes[used >= min(WINDOW, max(len(data), 1))]
        by[r["lang"]] += [full[int(i)] for i in np.linspace(0, len(full) - 1, min(per_text, len(full)))] if len(full) else []
    most = max(map(len, by.values()))
    rng = np.random.default_rng(3)
    pairs = [(w, i) for i, k in enumerate(languages) if by[k] for w in (by[k][j] for j in rng.permutation(most) % len(by[k]))]
    model = BiGRU(languages, hidden)
    if pairs and len(languages) > 1:
        model.fit(np.stack([w for w, _ in pairs]), np.array([i for _, i in pairs]), steps)
    return model


@functools.lru_cache(2)
def _load(blob: bytes) -> BiGRU:
    return pickle.loads(blob)


def identify(docs: DataFrame, model: BiGRU) -> DataFrame:
    """docs with lang_pred and score added; docs needs a column text. Other columns, of any name, are kept
    as they are; only columns named lang_pred or score are replaced.

    Null texts and texts without a letter get `und` and score 0, and so do all texts if the model
    knows no language. Whole texts are read, however long, in batches of bounded bytes; a prediction
    takes nothing but the text, so equal texts get equal rows. An empty table gives an empty result."""
    blob = pickle.dumps(model)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score"))).alias("row")
    rows = docs.select(row, F.col("text").cast("string").alias("text"))
    schema = rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def label(batches):
        from .tokens import slices

        m = _load(blob)
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts, 2 << 20):
                lang, score = predict(m, texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(released(label), schema).select("row.*", "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score")

"""Operator 4, language ID: a bidirectional gated recurrent network over bytes.

The network is trained here in numpy by backpropagation through time. It labels every byte
position of a text, in windows of ``WINDOW`` bytes, and pools the positions' probabilities
into one distribution for the document.

Defined results: a text that is null or has no letter gives ``und`` with score 0.0; with no
labelled text to learn from, every row is ``und``; with one language, that language. Rows that
repeat or share an id are scored each; columns other than the named ones are ignored. Invalid
or rare bytes have table rows like any others; a text of any length is cut into windows, so
memory depends on the Arrow batch and not on the longest text's recurrence. An empty table gives no rows. Of languages with equal
probability the first by code point is told.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewell.llm import vocab
from tidewell.llm.names import unused
from tidewell.session import written

WINDOW = 64
HIDDEN = 12
#: Bounds of the training sample: passages for each language and characters in each.
SAMPLE_PER_LANG = 700
SAMPLE_CHARS = 400
#: Bound of all passages together: with many languages each has fewer, but every one is learned.
SAMPLE = 140_000
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(doc_id):
    """Whether a row is kept out of training: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """About SAMPLE_PER_LANG passages of each language, drawn by a hash of the id; SAMPLE in all at most, but one of each language.

    A passage starts at a hashed place of its text. Only rows outside the held-out part with a
    language count. The bounds make the collected sample the same size for any input.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return []
    each = max(1, min(SAMPLE_PER_LANG, SAMPLE // len(counts)))
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, each / v))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    span = F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit("start")), span)
    kept = rows.where(draw < share[F.col("lang")]).select("lang", F.col("text").substr(start.cast("int"), F.lit(SAMPLE_CHARS)).alias("passage"), "doc_id")
    own = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("langid")), F.xxhash64("passage"))  # ids may repeat: then a draw has more rows
    kept = kept.withColumn("place", F.row_number().over(own)).where(F.col("place") <= 2 * each)
    got = [(r[0], r[1]) for r in kept.orderBy("doc_id", "passage").select("lang", "passage").collect()]  # 2 * each rows a language
    missed = sorted(set(counts) - {lang for lang, _ in got})
    if missed:  # of which no row was drawn
        one = rows.where(F.col("lang").isin(missed)).groupBy("lang").agg(F.min_by(F.substring("text", 1, SAMPLE_CHARS), F.xxhash64("doc_id", F.lit("langid"))).alias("passage"))
        got += [(r[0], r[1]) for r in one.orderBy("lang").collect()]
    return got


class ByteGru:
    """Weights of both directions. Gate order in the tables: update, reset, candidate."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.w = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.w["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 2 * hidden)).astype(np.float32)
            self.w["c" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden)).astype(np.float32)
        self.w["o"] = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32)
        self.w["ob"] = np.zeros(len(langs), np.float32)

    def states(self, windows: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, rows, hidden) of one direction over windows (rows, steps)."""
        h, n, steps = self.hidden, *windows.shape
        table, u, c = self.w["x" + d], self.w["u" + d], self.w["c" + d]
        out = np.empty((steps, n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        by_step = np.ascontiguousarray(windows.T)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = table[by_step[t]]
            gates = state @ u
            gates += x[:, : 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:, :h], gates[:, h:]
            cand = (r * state) @ c
            cand += x[:, 2 * h :]
            np.tanh(cand, out=cand)
            if keep is not None:
                keep.append((t, state, z, r, cand))
            state = state + z * (cand - state)
            out[t] = state
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities (steps, languages, rows) of every byte position.

        The same recurrence as states(), with a contiguous array for each gate, in which numpy's
        loops are long, and with the sigmoids' halves folded into the weights.
        """
        h, n, steps = self.hidden, *windows.shape
        by_step = np.ascontiguousarray(windows.T)
        logits = np.empty((steps, len(self.langs), n), np.float32)
        logits[:] = self.w["ob"][None, :, None]
        z, r, cand, x = (np.empty((n, h), np.float32) for _ in range(4))
        for d, into in (("f", self.w["o"][:h]), ("b", self.w["o"][h:])):
            tables = [np.ascontiguousarray(self.w["x" + d][:, k * h : (k + 1) * h]) * f for k, f in enumerate((0.5, 0.5, 1))]
            uz, ur, c, to_langs = self.w["u" + d][:, :h] * 0.5, self.w["u" + d][:, h:] * 0.5, self.w["c" + d] * 0.5, np.ascontiguousarray(into.T)
            state = np.zeros((n, h), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                at = by_step[t]
                np.matmul(state, uz, out=z)
                z += np.take(tables[0], at, axis=0, out=x, mode="clip")
                np.tanh(z, out=z)
                np.matmul(state, ur, out=r)
                r += np.take(tables[1], at, axis=0, out=x, mode="clip")
                np.tanh(r, out=r)
                r += 1
                r *= state
                np.matmul(r, c, out=cand)
                cand += np.take(tables[2], at, axis=0, out=x, mode="clip")
                np.tanh(cand, out=cand)
                cand -= state
                z += 1
                z *= 0.5
                z *= cand
                state += z
                logits[t] += to_langs @ state.T
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients by backpropagation through time; labels: one for each row."""
        h, n, steps = self.hidden, *windows.shape
        kept = {d: [] for d in "fb"}
        states = {d: self.states(windows, d, kept[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        logits = both @ self.w["o"] + self.w["ob"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        loss = -float(np.log(p[:, np.arange(n), labels] + 1e-9).mean())
        p[:, np.arange(n), labels] -= 1
        p /= n * steps
        grads = {"o": np.einsum("tnh,tnc->hc", both, p), "ob": p.sum(axis=(0, 1))}
        into = p @ self.w["o"].T
        for k, d in enumerate("fb"):
            u, c = self.w["u" + d], self.w["c" + d]
            gx, gu, gc = np.zeros_like(self.w["x" + d]), np.zeros_like(u), np.zeros_like(c)
            carry = np.zeros((n, h), np.float32)
            for t, before, z, r, cand in reversed(kept[d]):
                ds = into[t, :, k * h : (k + 1) * h] + carry
                dcand = ds * z * (1 - cand * cand)
                dz = ds * (cand - before) * z * (1 - z)
                back = dcand @ c.T
                dr = back * before * r * (1 - r)
                dgates = np.concatenate([dz, dr], axis=1)
                gc += (r * before).T @ dcand
                gu += before.T @ dgates
                np.add.at(gx, windows[:, t], np.concatenate([dgates, dcand], axis=1))
                carry = ds * (1 - z) + back * r + dgates @ u.T
            grads |= {"x" + d: gx, "u" + d: gu, "c" + d: gc}
        return loss, grads

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = 350, batch: int = 96, rate: float = 0.012, seed: int = 11) -> float:
        """Adam over random batches with an equal share for every language; returns the last losses' mean."""
        rng = np.random.default_rng(seed)
        pools = [np.flatnonzero(labels == k) for k in range(len(self.langs))]
        first, second, losses = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, []
        for i in range(1, steps + 1):
            rows = np.concatenate([rng.choice(p, max(1, batch // len(pools))) for p in pools if len(p)])
            loss, grads = self.gradients(windows[rows], labels[rows])
            losses.append(loss)
            lr = rate * min(1, i / 20) * (1 - i / (steps + 1)) ** 0.5
            for k, g in grads.items():
                np.clip(g, -1, 1, out=g)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                self.w[k] -= (lr * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.999**i)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:]))


def cut(raw: bytes, window: int = WINDOW) -> np.ndarray:
    """The windows (rows, window) of a text's bytes, the last filled up with spaces."""
    rows = max(1, -(-len(raw) // window))
    return np.frombuffer(raw.ljust(rows * window, b" "), np.uint8).reshape(rows, window)


def train(sample: list[tuple[str, str]], **fit) -> ByteGru | None:
    """A fitted network, or None without labelled text."""
    langs = sorted({lang for lang, text in sample if text})
    if not langs:
        return None
    windows = [(cut(text.encode("utf-8", "replace")), langs.index(lang)) for lang, text in sample if text]
    model = ByteGru(langs)
    if len(langs) > 1:
        model.fit(np.concatenate([w for w, _ in windows]), np.concatenate([np.full(len(w), k) for w, k in windows]), **fit)
    return model


#: True for bytes whose positions count in the pooled probabilities: ASCII letters and parts of longer code points.
COUNTED = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def score_texts(model: ByteGru | None, texts: list[str | None], most: int = 1024) -> list[tuple[str, float]]:
    """(language, score) of each text; windows of many texts run through the network together."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if model is None:
        return out
    sums = np.zeros((len(texts), len(model.langs)))
    pending, owners, held = [], [], 0

    def flush() -> None:
        nonlocal held
        if not pending:
            return
        windows = np.concatenate(pending)
        owner = np.concatenate(owners)
        for at in range(0, len(windows), most):
            part = windows[at : at + most]
            p = model.probabilities(part)
            p *= COUNTED[part.T][:, None, :]
            pooled = p.sum(axis=0)
            for k in range(len(pooled)):
                sums[:, k] += np.bincount(owner[at : at + most], pooled[k], len(texts))
        pending.clear()
        owners.clear()
        held = 0

    lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    for i in lettered:
        windows = cut(texts[i].encode("utf-8", "replace"))
        pending.append(windows)
        owners.append(np.full(len(windows), i))
        held += len(windows)
        if held >= most:
            flush()
    flush()
    for i in lettered:
        total = sums[i].sum()
        best = int(sums[i].argmax())
        out[i] = (model.langs[best], float(sums[i, best] / total) if total > 0 else 0.0)
    return out


def language_id(docs: DataFrame, model: ByteGru | None = None, fit: dict | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs (doc_id, text; lang to train on)."""
    if model is None:
        model = train(training_sample(docs), **(fit or {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab.forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = score_texts(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def least_score(scored: DataFrame, right: Column, score: Column) -> float:
    """The score under which predictions are wrong more often than right; scored: labelled rows outside the training part.

    Counted in hundredths of the score, so a hundred rows are gathered. 0.0 without such rows.
    """
    rows = scored.groupBy(F.floor(score * 100).cast("int").alias("part")).agg(F.count("*").alias("n"), F.count_if(right).alias("right")).collect()
    least, n, hits = 0.0, 0, 0
    for r in sorted(rows, key=lambda r: r["part"]):
        n, hits = n + r["n"], hits + r["right"]
        if 2 * hits < n:
            least = (r["part"] + 1) / 100
    return least


def known_language(docs: DataFrame, keep: list[str] | None = None, model: ByteGru | None = None, least: float | None = None) -> DataFrame:
    """The rows of docs, unchanged, whose text is in one of the languages to keep (all that are learned).

    A row goes if its text is null or has no letter, if its language is not kept, or if its score is under ``least``;
    that comes from the held-out part by least_score(), where it is not given. Rows that repeat or share an id are judged
    each; a very long text is read whole; an empty table gives no rows. Other columns may have any names.
    """
    if model is None:
        model = train(training_sample(docs))

    told, sure = unused(docs, "told"), unused(docs, "sure")
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab.forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = score_texts(model, part.column(at_text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*part.schema.names, told, sure])

    plain = docs.withColumn("text", F.col("text").cast("string"))
    schema = StructType([*plain.schema.fields, StructField(told, StringType()), StructField(sure, DoubleType())])
    scored = written(plain.mapInArrow(run, schema), "languages")
    lang, score = F.col(told), F.col(sure)
    known = lang != "und"
    if least is None:
        labelled = scored.where(known & F.col("lang").isNotNull() & held_out(F.col("doc_id"))) if "lang" in docs.columns else scored.limit(0)
        least = least_score(labelled, lang == labelled["lang"].cast("string"), score) if "lang" in docs.columns else 0.0
    known = known & (score >= least)
    return scored.where(known if keep is None else known & lang.isin(keep)).select(*docs.columns)

"""Language identification with a byte convolutional network trained in numpy.

A text is cut into windows of ``WINDOW`` bytes (the last one padded); bytes are embedded, filters of several widths run over
them, each filter's largest value in the window is kept, and a linear layer with softmax gives the languages.  A text's
logits are the mean over its windows, each weighted by its bytes, so every byte of every text is read.

Training rows are labelled rows only, of every language.  Per language about ``TRAIN_ROWS`` of them are drawn by a hash of id and text (equal
rows count once) and at most ``WINDOWS_PER_ROW`` windows spread over the text each: these bounds hold whatever the table size, so the
driver trains on a few hundred KB per language.

Defined cases: text that is null or holds no letter is ``und`` with score 0; null labels and null ids are not learned from; a
null id is not held out; with no labelled row at all every prediction is ``und``.  Rows are judged one by one, so repeated
rows get equal answers.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import textops as X

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 6
TRAIN_ROWS = 400
WINDOWS_PER_ROW = 4
EPOCHS = 12
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept for measuring: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


class ByteCNN:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, widest, n = langs, max(WIDTHS), FILTERS * len(WIDTHS)
        mask = np.zeros((widest, EMBED, n), np.float32)  # a filter of width w has weights on its first w bytes
        for k, w in enumerate(WIDTHS):
            mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = mask.reshape(widest * EMBED, n)
        self.p = {
            "embed": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),  # 256: padding
            "conv": (rng.normal(0, 0.4, (widest * EMBED, n)) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": rng.normal(0, 0.2, (n, len(langs))).astype(np.float32),
            "out_bias": np.zeros(len(langs), np.float32),
        }
        self.p["embed"][256] = 0

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """windows: ids of shape (n, WINDOW).  Logits, pooled values and the column matrix."""
        widest = max(WIDTHS)
        n, size = windows.shape
        x = np.zeros((n, size + widest - 1, EMBED), np.float32)
        x[:, :size] = self.p["embed"][windows]
        columns = np.empty((n, size, widest * EMBED), np.float32)
        for k in range(widest):
            columns[:, :, k * EMBED : (k + 1) * EMBED] = x[:, k : k + size]
        found = (columns.reshape(n * size, -1) @ self.p["conv"]).reshape(n, size, -1)
        return found, columns, windows

    def logits(self, windows: np.ndarray) -> np.ndarray:
        found, _, _ = self.forward(windows)
        return np.maximum(found.max(axis=1) + self.p["bias"], 0) @ self.p["out"] + self.p["out_bias"]

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross-entropy of single windows."""
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        weight = np.ones(len(self.langs), np.float32)
        counts = np.bincount(labels, minlength=len(self.langs))
        weight[counts > 0] = counts.sum() / (counts[counts > 0] * (counts > 0).sum())
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                step += 1
                for name, g in self._gradients(windows[pick], labels[pick], weight).items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                self.p["embed"][256] = 0

    def _gradients(self, windows, labels, weight):
        n, size = windows.shape
        found, columns, _ = self.forward(windows)
        top = found.argmax(axis=1)
        rows = np.arange(n)[:, None]
        raw = found[rows, top, np.arange(found.shape[2])] + self.p["bias"]
        pooled = np.maximum(raw, 0)
        z = pooled @ self.p["out"] + self.p["out_bias"]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = e / e.sum(axis=1, keepdims=True)
        d[np.arange(n), labels] -= 1
        d *= (weight[labels] / n)[:, None]
        back = (d @ self.p["out"].T) * (raw > 0)
        seen = columns[rows, top]  # n, filters, widest * EMBED
        g_conv = np.einsum("nfc,nf->cf", seen, back) * self.mask
        g_columns = back[:, :, None] * (self.p["conv"] * self.mask).T[None]
        g_embed = np.zeros_like(self.p["embed"])
        padded = np.concatenate([windows, np.full((n, max(WIDTHS) - 1), 256)], axis=1)
        for k in range(max(WIDTHS)):
            np.add.at(g_embed, padded[rows, top + k], g_columns[:, :, k * EMBED : (k + 1) * EMBED])
        return {"embed": g_embed, "conv": g_conv.astype(np.float32), "bias": back.sum(axis=0), "out": pooled.T @ d, "out_bias": d.sum(axis=0)}


def _windows(block: X.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, row of each window, bytes of each window) of the whole texts; ASCII capitals count as small letters."""
    size = np.diff(block.offsets)
    per_row = -(-size // WINDOW)
    rows = np.repeat(np.arange(len(size)), per_row)
    at = block.offsets[:-1][rows] + WINDOW * X.ranges(np.zeros(len(size), np.int64), per_row)
    length = np.minimum(WINDOW, block.offsets[1:][rows] - at)
    data = np.concatenate([X.LOWER[block.data], np.zeros(WINDOW, np.uint8)])
    ids = data[at[:, None] + np.arange(WINDOW)].astype(np.int16)
    short = np.flatnonzero(length < WINDOW)
    ids[short] = np.where(np.arange(WINDOW) < length[short][:, None], ids[short], 256)
    return ids, rows, length


def _sample(batches):
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for block in X.blocks(batch.column("text")):
            ids, rows, _ = _windows(block)
            first = np.searchsorted(rows, np.arange(len(block)))
            count = np.searchsorted(rows, np.arange(len(block)), "right") - first
            picks, names = [], []
            for k in range(len(block)):
                spread = np.unique(np.linspace(0, count[k] - 1, min(count[k], WINDOWS_PER_ROW)).astype(int)) if count[k] else []
                picks += [first[k] + s for s in spread]
                names += [langs[block.first + k]] * len(spread)
            if picks:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([ids[p].tobytes() for p in picks], pa.binary())], ["lang", "ids"])


def trained(labelled: DataFrame, rows: int = TRAIN_ROWS, langs: int | None = None) -> ByteCNN:
    """A model from (doc_id, text, lang) rows, about ``rows`` per language; with ``langs`` only the most frequent languages are learned."""
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    counts = (counts if langs is None else counts.limit(langs)).collect()
    model = ByteCNN(sorted(r["lang"] for r in counts))
    if not counts:
        return model
    # about `rows` per language, drawn by the hash of id and text, equal rows once; a language with fewer rows gives them all
    scale = 1 << 20
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(max(1, min(scale, -(-scale * rows // r["count"])))))])
    drawn = usable.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id", "text"), F.lit(scale)) < share[F.col("lang")])
    drawn = drawn.select("lang", "doc_id", "text").distinct()
    got = sorted((r["lang"], bytes(r["ids"])) for r in drawn.select("lang", "text").mapInArrow(_sample, "lang string, ids binary").collect())
    if got:
        place = {x: k for k, x in enumerate(model.langs)}
        model.train(np.stack([np.frombuffer(x, np.int16) for _, x in got]).astype(np.int64), np.array([place[x] for x, _ in got]))
    return model


def _predict(batches, model: ByteCNN, keep: list[str]):
    known = np.array(model.langs, object)
    for batch in batches:
        letters = np.asarray(batch.column("has_letter_"))
        for block in X.blocks(batch.column("text"), 1 << 18):
            total = np.zeros((len(block), max(1, len(known))))
            if len(known) and block.offsets[-1]:
                ids, rows, length = _windows(block)
                for lo in range(0, len(ids), 512):
                    np.add.at(total, rows[lo : lo + 512], model.logits(ids[lo : lo + 512]) * length[lo : lo + 512, None])
            z = total / np.maximum(1, np.diff(block.offsets))[:, None]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            ok = letters[block.first : block.first + len(block)] & (len(known) > 0)
            names = list(np.where(ok, known[p.argmax(axis=1)], UNKNOWN)) if len(known) else [UNKNOWN] * len(block)
            own = [pa.array(names, pa.string()), pa.array(np.where(ok, p.max(axis=1), 0.0))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(block.first, len(block)) for c in keep], *own], [*keep, "lang_pred", "score"])


def predict(docs: DataFrame, model: ByteCNN, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in ``carry``, lang_pred and score, from the text alone."""
    keep = list(carry)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"
    read = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("has_letter_", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return read.mapInArrow(partial(_predict, model=model, keep=keep), schema)


def keep_known(docs: DataFrame, model: ByteCNN, min_score: float = 0.35) -> DataFrame:
    """The documents that the model can place in a language, with their columns."""
    plain, back = X.neutral(docs, "text")
    return back(predict(plain, model, tuple(plain.columns)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)))

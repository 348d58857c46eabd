"""Languages of documents and of their segments by a bidirectional gated recurrent network over bytes.

A gated recurrent unit runs over the UTF-8 of a text in either direction, in steps of eight bytes: the input of a step is the sum
of embeddings of its hashed byte pairs.  Each byte position then gets a distribution over the languages of its own, from the
states of its step and its own pair.  The network is trained in numpy by backpropagation through time, on a bounded sample of rows
with their given labels.  As labels are wrong in part, sentences that the network contradicts clearly are left out of the later
training; close ones are drawn more often.  Log-probabilities are pooled over sentences with a temperature that is fitted to
held-out sentences, so that a confidence is a probability, and those of sentences over the document.  Where the positions of a
line speak for several languages, a Viterbi pass with a cost for each switch finds the segments within it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textops import WORD, visible_text

BLOCK, TABLE, DIM, HIDDEN = 8, 4096, 16, 16
PAYLOAD, MARGIN, GAP = 112, 8, 2  # blocks of a row that count, of context on either side, of silence between documents
#: What a switch of language within a line must gain, in nats of the pooled log-probabilities.
SWITCH = 12.0

# Spellings of the languages' names, by code.
NAMES = {
    "ar": "ar ara arabic العربية عربي عربية", "de": "de deu ger german deutsch", "en": "en eng english", "es": "es spa spanish español espanol castellano",
    "fa": "fa fas per persian farsi فارسی", "fr": "fr fra fre french français francais", "pt": "pt por portuguese português portugues",
}
CODES = {name: code for code, names in NAMES.items() for name in names.split()}
LANGUAGES = sorted(NAMES)

SENTENCE = re.compile(r"(?<=[.!?؟。۔])[\"'”’»)\]*_]*\s+|\s*\n\s*")
WHOLE = re.compile(r"[.!?؟。۔][\"'”’»)\]*_]*$")


def code_of(label: str | None) -> str | None:
    """The language code that a label names in any spelling; null for null, empty and unknown labels."""
    if not label:
        return None
    plain = label.strip().lower()
    return CODES.get(plain) or CODES.get(re.split(r"[-_ (]", plain)[0])


def spans_of(text: str | None) -> list[tuple[int, str]]:
    """(place, text) of the sentences and lines of the visible text that hold a letter; places count its characters."""
    seen, out, at = visible_text(text), [], 0
    for end, following in [*(m.span() for m in SENTENCE.finditer(seen)), (len(seen), len(seen))]:
        part = seen[at:end] + seen[end:following].rstrip()  # quotes and marks after the stop belong to the sentence
        if any(map(str.isalpha, part)):
            out.append((at + len(part) - len(part.lstrip()), part.strip()))
        at = following
    return out


def segments_of(text: str | None) -> list[str]:
    """The sentences and lines of the visible text that hold a letter."""
    return [s for _, s in spans_of(text)]


def blocks_of(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte pairs (blocks, BLOCK) of the segments, each filled up to whole blocks, and the number of blocks of each."""
    raw = [s.lower().encode("utf-8", "replace") for s in segments]
    counts = np.array([-(-len(b) // BLOCK) for b in raw], np.int64)
    data = np.frombuffer(b"".join(b.ljust(n * BLOCK, b" ") for b, n in zip(raw, counts)), np.uint8).astype(np.uint32)
    pair = data * np.uint32(257) + np.r_[data[1:], np.uint32(32)] if len(data) else data
    return ((pair * np.uint32(2654435761)) >> np.uint32(20)).reshape(-1, BLOCK).astype(np.int32), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The parameters p and the passes; arrays are (time, rows, features), float32."""

    def __init__(self, classes: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": (0.3 * rng.standard_normal((TABLE, DIM))).astype(np.float32), "V": g(2 * HIDDEN, classes), "Q": g(DIM, classes), "c": np.zeros(classes, np.float32)}
        self.temperature = 0.5
        for d in "fb":
            self.p |= {f"W{d}": g(DIM, 3 * HIDDEN), f"U{d}": g(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def _direction(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        steps, rows, _ = x.shape
        gates = (x.reshape(-1, DIM) @ self.p[f"W{d}"] + self.p[f"b{d}"]).reshape(steps, rows, 3 * HIDDEN)
        h, u, out, saved = np.zeros((rows, HIDDEN), np.float32), self.p[f"U{d}"], np.empty((steps, rows, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            hu = h @ u
            zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            before, h = h, n + z * (h - n)
            out[t] = h
            if keep:
                saved.append((t, before, z, r, n, hu[:, 2 * HIDDEN :]))
        return out, saved

    def inputs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of the positions (..., BLOCK, DIM) and of the steps (..., DIM); -1 marks silence."""
        own = self.p["E"][np.maximum(codes, 0)]
        own[codes[..., 0] < 0] = 0
        return own, own.sum(axis=-2)

    def _logits(self, h: np.ndarray, own: np.ndarray) -> np.ndarray:
        y = own @ self.p["Q"] + (h @ self.p["V"] + self.p["c"])[..., None, :]
        return y - y.max(axis=-1, keepdims=True)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """(time, rows, BLOCK, classes): of each byte position."""
        own, x = self.inputs(codes)
        h = np.concatenate([self._direction(x, "f", False)[0], self._direction(x, "b", False)[0]], axis=2)
        y = self._logits(h, own)
        return y - np.log(np.exp(y).sum(axis=-1, keepdims=True))

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy of the positions of steps with a label (0 or more) and its gradients, by backpropagation through time."""
        p, g, (own, x) = self.p, {}, self.inputs(codes)
        (hf, sf), (hb, sb) = self._direction(x, "f", True), self._direction(x, "b", True)
        h = np.concatenate([hf, hb], axis=2)
        y = np.exp(self._logits(h, own))
        y /= y.sum(axis=-1, keepdims=True)
        used = labels >= 0
        n = max(1, used.sum()) * BLOCK
        t, r = np.nonzero(used)
        loss = -np.log(y[t, r, :, labels[used]] + 1e-9).sum() / n
        y[t, r, :, labels[used]] -= 1
        y *= (used / np.float32(n))[..., None, None].astype(np.float32)
        step = y.sum(axis=2)
        g["V"] = h.reshape(-1, 2 * HIDDEN).T @ step.reshape(-1, step.shape[2])
        g["c"] = step.sum(axis=(0, 1))
        g["Q"] = own.reshape(-1, DIM).T @ y.reshape(-1, y.shape[3])
        dh_out = step @ p["V"].T
        dx = np.zeros_like(x)
        for d, saved, part in (("f", sf, dh_out[..., :HIDDEN]), ("b", sb, dh_out[..., HIDDEN:])):
            dgates = np.zeros((*x.shape[:2], 3 * HIDDEN), np.float32)
            du, dh = np.zeros_like(p[f"U{d}"]), np.zeros((x.shape[1], HIDDEN), np.float32)
            for k, before, z, r, n_, hun in reversed(saved):
                dh = dh + part[k]
                dn = dh * (1 - z) * (1 - n_ * n_)
                dz = dh * (before - n_) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                dgates[k] = np.concatenate([dz, dr, dn], axis=1)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                du += before.T @ dhu
                dh = dh * z + dhu @ p[f"U{d}"].T
            flat = dgates.reshape(-1, 3 * HIDDEN)
            g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = du, x.reshape(-1, DIM).T @ flat, flat.sum(axis=0)
            dx += (flat @ p[f"W{d}"].T).reshape(x.shape)
        live = codes[..., 0] >= 0
        grad = (dx[live][:, None, :] + y[live] @ p["Q"].T).reshape(-1, DIM)
        index = codes[live].ravel()
        g["E"] = np.stack([np.bincount(index, grad[:, k], TABLE) for k in range(DIM)], axis=1).astype(np.float32)
        return float(loss), g


def _steps(net: Network, codes: np.ndarray, counts: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Log-probabilities (blocks, classes), the mean of each block's positions; counts: blocks of each segment, segments: of each document."""
    between = np.ones(len(counts), np.int64)  # silence before a sentence, so that none is read as going on from the last
    between[np.r_[0, np.cumsum(segments)[:-1]]] = GAP
    first = np.cumsum(counts + between) - counts  # where a sentence's blocks go
    total = int(first[-1] + counts[-1]) + GAP
    rows = -(-total // PAYLOAD)
    line = np.full((MARGIN + rows * PAYLOAD + MARGIN, BLOCK), -1, np.int32)
    at = np.repeat(first - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    line[MARGIN + at] = codes
    width = PAYLOAD + 2 * MARGIN
    view = np.lib.stride_tricks.sliding_window_view(line, width, axis=0)[::PAYLOAD]  # (rows, BLOCK, width)
    out = np.empty((rows, PAYLOAD, net.p["c"].size), np.float32)
    for k in range(0, rows, 256):
        y = net.log_probabilities(np.ascontiguousarray(view[k : k + 256].transpose(2, 0, 1))).mean(axis=2)
        out[k : k + 256] = y[MARGIN : MARGIN + PAYLOAD].transpose(1, 0, 2)
    return out.reshape(rows * PAYLOAD, -1)[at]


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(counts)[:-1]]


def _scores(net: Network, codes: np.ndarray, counts: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Sums of the blocks' log-probabilities (segments of all documents, classes)."""
    return np.add.reduceat(_steps(net, codes, counts, segments), _starts(counts), axis=0)


def softmax(x: np.ndarray) -> np.ndarray:
    y = np.exp(x - x.max(axis=-1, keepdims=True))
    return y / y.sum(axis=-1, keepdims=True)


def fitted_temperature(scores: np.ndarray, label: np.ndarray) -> float:
    """The factor of pooled log-probabilities under which held-out labels are likeliest; as many of them as are contradicted may be wrong."""
    wrong = min(0.5, max(0.002, float((scores.argmax(axis=1) != label).mean())))
    best, least = 0.5, math.inf
    for t in np.geomspace(0.02, 2.0, 40):
        p = softmax(t * scores)[np.arange(len(label)), label]
        loss = -np.log((1 - wrong) * p + wrong / scores.shape[1]).mean()
        if loss < least - 1e-9:
            best, least = float(t), loss
    return best


def reliability(confidence: np.ndarray, right: np.ndarray, bins: int = 10) -> tuple[float, list[tuple[float, float, int]]]:
    """Expected calibration error, and (mean confidence, share that is right, number) of each bin of confidences."""
    at = np.minimum((confidence * bins).astype(int), bins - 1)
    table = [(float(confidence[at == k].mean()), float(right[at == k].mean()), int((at == k).sum())) for k in range(bins) if (at == k).any()]
    return sum(abs(c - r) * n for c, r, n in table) / max(1, len(confidence)), table


def train(texts: list[tuple[str, str]], steps: int = 600, rows: int = 128, length: int = 40, seed: int = 5, clear: float = 6.0) -> Network:
    """A network fitted to (text, language code); needs texts of at least one language.

    A draw shows at most ``length`` blocks of a sentence, from anywhere in it.  Each tenth sentence is held out for the temperature.
    A sentence is left out from a third of the steps on while the network's sum of log-probabilities for another language is
    higher by more than ``clear``; in the last third half of the draws come from the tenth of the sentences nearest to another language.
    """
    rng, net = np.random.default_rng(seed), Network(len(LANGUAGES), seed)
    pieces = []  # (codes, label) of each sentence
    for text, code in texts:
        segments = segments_of(text)
        if segments:
            codes, counts = blocks_of(segments)
            pieces += [(c, LANGUAGES.index(code)) for c in np.split(codes, np.cumsum(counts)[:-1])]
    if not pieces:
        raise ValueError("no labelled text to train on")
    held = [p for k, p in enumerate(pieces) if k % 10 == 9]
    pieces = [p for k, p in enumerate(pieces) if k % 10 != 9]
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    label = np.array([y for _, y in pieces])
    every = lambda use: [i for i in (np.flatnonzero(use & (label == y)) for y in range(len(LANGUAGES))) if len(i)]
    by_label, near = every(np.ones(len(pieces), bool)), []

    def scores(of: list) -> np.ndarray:
        counts = np.array([len(c) for c, _ in of])
        return _scores(net, np.concatenate([c for c, _ in of]), counts, np.ones(len(of), np.int64))

    def batch() -> tuple[np.ndarray, np.ndarray]:
        codes, labels = np.full((length, rows, BLOCK), -1, np.int32), np.full((length, rows), -1, np.int64)
        for r in range(rows):
            t = 0
            while t < length:
                groups = near if near and rng.random() < 0.5 else by_label
                mine = groups[rng.integers(len(groups))]
                k = int(mine[rng.integers(len(mine))])
                whole = pieces[k][0]
                begin = int(rng.integers(max(1, len(whole) - (length - t) + 1)))
                part = whole[begin : begin + length - t]
                codes[t : t + len(part), r], labels[t : t + len(part), r] = part, label[k]
                t += len(part) + 1
        return codes, labels

    for step in range(1, steps + 1):
        if step in (steps // 3, 2 * steps // 3, 5 * steps // 6) and step > 1:
            s = scores(pieces)
            own = s[np.arange(len(label)), label].copy()
            s[np.arange(len(label)), label] = -np.inf
            margin = own - s.max(axis=1)
            by_label = every(margin > -clear)
            if step > steps // 3:
                near = every((margin > -clear) & (margin <= np.quantile(margin[margin > -clear], 0.1)))
        _, g = net.gradients(*batch())
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.01 * min(1.0, step / 50) * (1 if step < 0.7 * steps else 0.25 if step < 0.9 * steps else 0.06)
        for k, x in g.items():
            x = x / max(1.0, norm)
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    if held:
        net.temperature = fitted_temperature(scores(held), np.array([y for _, y in held]))
    return net


def sample(df: DataFrame, id_col: str, text_col: str, label_col: str, size: int = 3000) -> list[tuple[str, str]]:
    """At most ``size`` labelled texts, chosen by a hash of the id: the bound of what the network is fitted to.

    The labelled rows are counted first, so that about ``size`` of them, and not as many from each task, come to the driver.
    """
    known = F.lower(F.trim(label_col)).isin(*CODES) | F.split(F.lower(F.trim(label_col)), "[-_]")[0].isin(*CODES)
    labelled = df.where(known)
    share = min(1.0, 0.95 * size / max(1, labelled.count()))
    at = F.xxhash64(F.lit(11), id_col)
    rows = labelled.where(F.pmod(at, F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = rows.where(F.length(text_col) > 0).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), at.alias("at"))
    return [(r["text"], code_of(r["label"])) for r in sorted(rows.collect(), key=lambda r: (r["at"], r["text"]))[:size]]


OUT = (
    "id bigint, n_words int, label string, lang string, confidence double, sentence_langs array<string>, "
    "segments array<struct<start:int,end:int,lang:string,confidence:double>>"
)


def switches(y: np.ndarray, cost: float = SWITCH) -> list[tuple[int, int, int]]:
    """(first block, end, class) of the cheapest division of a line: y are scaled log-probabilities (blocks, classes)."""
    best, came = y[0].copy(), []
    for row in y[1:]:
        k = int(best.argmax())
        stay = best >= best[k] - cost
        came.append(np.where(stay, np.arange(len(best)), k))
        best = np.where(stay, best, best[k] - cost) + row
    path = [int(best.argmax())]
    for origin in reversed(came):
        path.append(int(origin[path[-1]]))
    path = path[::-1]
    at = [0, *(k for k in range(1, len(path)) if path[k] != path[k - 1]), len(path)]
    return [(a, z, path[a]) for a, z in zip(at, at[1:])]


def _place(sentence: str, block: int) -> int:
    """The character of a sentence at the start of a block, moved to the end of the white space nearest to it."""
    k = len(sentence.lower().encode("utf-8", "replace")[: block * BLOCK].decode("utf-8", "ignore"))
    gaps = [m.end() for m in re.finditer(r"\s+", sentence)]
    return min(gaps, key=lambda g: abs(g - k), default=min(k, len(sentence)))


def identify(df: DataFrame, id_col: str, text_col: str, label_col: str, net: Network | None = None, sure: float = 0.8, least_words: int = 4) -> DataFrame:
    """One row for each row of ``df``: its words, its label's language, its own language with a confidence, and its segments.

    sentence_langs: languages in which it has at least one whole sentence (an end mark, ``least_words`` words, confidence ``sure``).
    segments: runs in one language, over sentences and within lines: places of the visible text, language, confidence.
    Null, empty and letterless texts have null lang and confidence and no segments.  Ids may be null or repeat; other columns aren't read.
    """
    net = net or train(sample(df, id_col, text_col, label_col))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    parts, temperature = dict(net.p), net.temperature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.__new__(Network)
        own.p = parts
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids, texts, labels = (part.column(c).to_pylist() for c in range(3))
                split = [spans_of(t) for t in texts]
                flat = [s for x in split for _, s in x]
                n = np.array([len(x) for x in split], np.int64)
                out = []
                if flat:
                    codes, counts = blocks_of(flat)
                    y = temperature * _steps(own, codes, counts, n[n > 0])
                    starts = _starts(counts)
                    pooled = np.add.reduceat(y, starts, axis=0)
                    prob = softmax(pooled)
                    first = pooled.argmax(axis=1)
                    doubt = y.max(axis=1) - y[np.arange(len(y)), np.repeat(first, counts)]
                    mixed = np.add.reduceat(doubt, starts) > SWITCH  # no division can gain more than this
                at = 0
                for i, text, label, segs in zip(ids, texts, labels, split):
                    words = len(WORD.findall(visible_text(text)))
                    if not segs:
                        out.append((i, words, code_of(label), None, None, [], []))
                        continue
                    q, w, best = prob[at : at + len(segs)], counts[at : at + len(segs)], first[at : at + len(segs)]
                    doc = (q * w[:, None]).sum(axis=0) / w.sum()
                    whole = {int(best[j]) for j, (_, s) in enumerate(segs) if q[j, best[j]] >= sure and WHOLE.search(s) and len(WORD.findall(s)) >= least_words}
                    runs: list[list] = []  # start, end, class, confidence times blocks, blocks
                    for j, (place, s) in enumerate(segs):
                        spans = [(0, len(s), int(best[j]), float(q[j, best[j]]), int(w[j]))]
                        if mixed[at + j]:
                            line = y[starts[at + j] : starts[at + j] + w[j]]
                            cut = switches(line)
                            places = [0, *(_place(s, a) for a, _, _ in cut[1:]), len(s)]
                            spans = [(c, d, x, float(softmax(line[a:z].sum(axis=0))[x]), z - a) for (a, z, x), c, d in zip(cut, places, places[1:])]
                        for c, d, x, sureness, size in spans:
                            if runs and runs[-1][2] == x:
                                runs[-1][1] = place + d
                                runs[-1][3] += sureness * size
                                runs[-1][4] += size
                            elif d > c:
                                runs.append([place + c, place + d, x, sureness * size, size])
                    found = [{"start": r[0], "end": r[1], "lang": LANGUAGES[r[2]], "confidence": r[3] / r[4]} for r in runs]
                    out.append((i, words, code_of(label), LANGUAGES[int(doc.argmax())], float(doc.max()), sorted(LANGUAGES[x] for x in whole), found))
                    at += len(segs)
                names = ["id", "n_words", "label", "lang", "confidence", "sentence_langs", "segments"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=names)

    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])
    arrow = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(span)]
    return rows.mapInArrow(run, OUT)


def mislabelled(found: DataFrame, least_words: int = 10) -> DataFrame:
    """(id, lang) of rows of ``identify`` whose label is missing or wrong or that mix languages: a row for each language.

    A text without a whole sentence stands with its document language.
    """
    langs = F.when(F.size("sentence_langs") > 0, F.col("sentence_langs")).otherwise(F.array("lang"))
    rows = found.where((F.col("n_words") >= least_words) & F.col("lang").isNotNull()).withColumn("langs", langs)
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.coalesce("label", F.lit("")))
    return rows.where(wrong).select("id", F.explode("langs").alias("lang"))

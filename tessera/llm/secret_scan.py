"""Secrets by patterns, and by a character convolutional network over every candidate.

Three base patterns always count. Beside them every run of 16 or more key
characters is a candidate, read with 24 characters before it and 8 after by a
small convolutional network: a convolution of width 5 over character classes and
letters, the maximum and the mean over the whole candidate (long ones in
stretches of 32 that are pooled together), one hidden layer, a logit.

Labelled findings are the candidates that a base pattern touches; other
candidates are ordinary. The network learns from a sample of at most
``per_class`` windows of findings and twice as many ordinary ones, taken by hash,
copies once, from documents outside the calibration fold. Findings are shown once
more with characters redrawn from several alphabets, and again so in the
surroundings of ordinary candidates, so that a key is known by its own look. What
follows covers all rows: every candidate is scored and written, findings also
without their surroundings, the logits of the whole calibration fold are counted
in bins, a logistic curve through them turns logits into probabilities, and the
threshold keeps ``recall`` of the fold's findings when their surroundings are
hidden, since that is how the patterns miss a key.

Cases: a null text is empty and has no spans. A candidate that a base span touches
adds nothing, since the base span stays. Without labelled findings, or without
ordinary candidates, nothing is added. Texts of any length are read whole;
repeated rows and ids are judged row by row; an empty table gives no rows. Kept
columns may have any names but those of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm._shared import written

KINDS = ("assign", "access", "hex", "learned")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")

BEFORE, STRETCH, AFTER = 24, 32, 8
SPAN = BEFORE + STRETCH + AFTER
WIDTH, FILTERS, HIDDEN = 5, 16, 16
#: Windows that are scored at a time, and the logits' bins.
AT_ONCE, BIN, MOST_LOGIT = 2048, 0.05, 20.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings in order; a match that is too short is dropped, not shortened."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """The maximal runs of 16 or more key characters."""
    return [m.span() for m in _CANDIDATE.finditer(text)]


def touched(runs: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which runs share a character with a span; runs are disjoint and ascending."""
    out = np.zeros(len(runs), dtype=bool)
    if runs and spans:
        starts, ends = np.array(runs).T
        for a, _, b in spans:
            out[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = True
    return out


# --- symbols -----------------------------------------------------------------

_SIGNS = "+/_.=-'\":;,()<>@ \n\t"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SYMBOLS = ["\0", *_LETTERS, *_LETTERS.upper(), *"0123456789", *_SIGNS, "other sign", "beyond ascii"]


def _class_of(symbol: str) -> str:
    """Digits are one class; letters go by case, and by whether hexadecimal has them or they are vowels; others are their own."""
    if len(symbol) > 1 or not symbol.isalnum():
        return symbol
    if symbol.isdigit():
        return "digit"
    kind = "hex" if symbol in "abcdefABCDEF" else "vowel" if symbol in "iouIOU" else "other"
    return f"{kind} {'upper' if symbol.isupper() else 'lower'}"


_CLASSES = list(dict.fromkeys(map(_class_of, _SYMBOLS)))
CHANNELS = len(_CLASSES) + len(_LETTERS) + 1


def _lookup() -> np.ndarray:
    out = np.full(129, _SYMBOLS.index("other sign"), dtype=np.int64)
    for i, s in enumerate(_SYMBOLS):
        if len(s) == 1:
            out[ord(s)] = i
    out[128] = _SYMBOLS.index("beyond ascii")
    return out


def _features() -> np.ndarray:
    """Channels of each symbol: its class, its letter; the last channel is for the inside of a candidate."""
    out = np.zeros((len(_SYMBOLS), CHANNELS), dtype=np.float32)
    for i, s in enumerate(_SYMBOLS):
        out[i, _CLASSES.index(_class_of(s))] = 1
        if len(s) == 1 and s.lower() in _LETTERS:
            out[i, len(_CLASSES) + _LETTERS.index(s.lower())] = 1
    return out


LOOKUP, FEATURES = _lookup(), _features()


def windows(text: str, runs: list[tuple[int, int]], bare: bool = False) -> tuple[list[str], list[int], list[int]]:
    """Stretches of the candidates, each ``SPAN`` characters with what surrounds it (if ``bare``, of the candidate only): strings, lengths inside, number of the run."""
    out, inside, of = [], [], []
    for k, (a, b) in enumerate(runs):
        least, most = (a, b) if bare else (0, len(text))
        for s in range(a, b, STRETCH):
            e = min(b, s + STRETCH)
            out.append((text[max(least, s - BEFORE) : s].rjust(BEFORE, "\0") + text[s : min(most, e + AFTER)]).ljust(SPAN, "\0"))
            inside.append(e - s)
            of.append(k)
    return out, inside, of


def encoded(strings: list[str], inside: list[int]) -> np.ndarray:
    """Symbol numbers of windows, raised by the number of symbols inside the candidate."""
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, SPAN)
    place = np.arange(SPAN)
    own = (place >= BEFORE) & (place < BEFORE + np.array(inside, dtype=np.int64)[:, None])
    return (LOOKUP[np.minimum(points, 128)] + len(_SYMBOLS) * own).astype(np.int16)


# --- network -----------------------------------------------------------------


@dataclass
class CharNetwork:
    """Weights by name, and the curve and threshold that calibration sets."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    threshold: float | None = None  # None: nothing is accepted

    def tables(self) -> np.ndarray:
        """What each symbol adds at each offset of the convolution."""
        inside = np.concatenate((FEATURES, FEATURES))
        inside[len(FEATURES) :, -1] = 1
        return np.stack([inside @ w for w in self.weights["conv"]])

    def pooled(self, codes: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum and sum of the activations of each window."""
        n = SPAN - WIDTH + 1
        act = np.take(tables[0], codes[:, :n], axis=0)
        for o in range(1, WIDTH):
            act += np.take(tables[o], codes[:, o : o + n], axis=0)
        act += self.weights["conv_b"]
        np.maximum(act, 0, out=act)
        return act.max(axis=1), act.sum(axis=1)

    def logits(self, strings: list[str], inside: list[int], of: list[int], n: int) -> np.ndarray:
        """A logit for each of ``n`` candidates from its windows, which come in order."""
        top, total = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS), np.float32)
        tables, owner = self.tables(), np.array(of, dtype=np.int64)
        for s in range(0, len(strings), AT_ONCE):
            high, summed = self.pooled(encoded(strings[s : s + AT_ONCE], inside[s : s + AT_ONCE]), tables)
            own = owner[s : s + AT_ONCE]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            top[own[starts]] = np.maximum(top[own[starts]], np.maximum.reduceat(high, starts))
            total[own[starts]] += np.add.reduceat(summed, starts)
        return self._decided(top, total / np.maximum(np.bincount(owner, minlength=n), 1)[:, None])

    def _decided(self, top: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Logits from the maxima and the mean sums of windows."""
        w = self.weights
        hidden = np.maximum(np.concatenate((top, total / (SPAN - WIDTH + 1)), axis=1) @ w["hidden"] + w["hidden_b"], 0)
        return np.clip(hidden @ w["out"] + w["out_b"], -MOST_LOGIT, MOST_LOGIT)

    def window_logits(self, codes: np.ndarray) -> np.ndarray:
        """A logit for each encoded window by itself."""
        return self._decided(*self.pooled(codes, self.tables()))

    def probability(self, logit: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(F.lit(self.slope) * logit + F.lit(self.shift))))


def _trained(codes: np.ndarray, y: np.ndarray, rounds: int, rate: float = 0.01) -> CharNetwork:
    """Adam on the logistic loss; the classes weigh the same."""
    rng = np.random.default_rng(0)
    shapes = {"conv": (WIDTH, CHANNELS, FILTERS), "conv_b": (FILTERS,), "hidden": (2 * FILTERS, HIDDEN), "hidden_b": (HIDDEN,), "out": (HIDDEN,), "out_b": ()}
    w = {k: (rng.normal(0, 0.15 if k == "conv" else 0.3, s) if not k.endswith("_b") else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    first, second = ({k: np.zeros(s, np.float32) for k, s in shapes.items()} for _ in range(2))
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    n, step = SPAN - WIDTH + 1, 0
    flat = lambda: w["conv"].reshape(WIDTH * CHANNELS, FILTERS)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            x = FEATURES[codes[part] % len(_SYMBOLS)]
            x[..., -1] = codes[part] >= len(_SYMBOLS)
            runs = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(part), n, WIDTH * CHANNELS)
            act = np.maximum(runs @ flat() + w["conv_b"], 0)
            where = act.argmax(axis=1)
            pool = np.concatenate((act.max(axis=1), act.mean(axis=1)), axis=1)
            hidden = np.maximum(pool @ w["hidden"] + w["hidden_b"], 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_b"], -30, 30)))
            d_out = ((p - y[part]) * weight[part] / len(part)).astype(np.float32)
            d_hidden = np.outer(d_out, w["out"]) * (hidden > 0)
            d_pool = d_hidden @ w["hidden"].T
            d_act = np.repeat(d_pool[:, None, FILTERS:] / n, n, axis=1)
            np.add.at(d_act, (np.arange(len(part))[:, None], where, np.arange(FILTERS)), d_pool[:, :FILTERS])
            d_act *= act > 0
            grad = {
                "conv": (runs.reshape(-1, WIDTH * CHANNELS).T @ d_act.reshape(-1, FILTERS)).reshape(shapes["conv"]), "conv_b": d_act.sum(axis=(0, 1)),
                "hidden": pool.T @ d_hidden, "hidden_b": d_hidden.sum(axis=0), "out": hidden.T @ d_out, "out_b": d_out.sum(),
            }
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return CharNetwork(w)


#: Alphabets from which the characters of findings are redrawn.
_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def _varied(codes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sample, findings with redrawn characters in their own and in ordinary surroundings, and some of all without any."""
    rng = np.random.default_rng(1)
    drawn, moved = codes[y == 1].copy(), []
    for row in drawn:
        inside = np.flatnonzero(row >= len(_SYMBOLS))
        alphabet = LOOKUP[np.frombuffer(_ALPHABETS[rng.integers(len(_ALPHABETS))].encode(), dtype=np.uint8)]
        row[inside] = rng.choice(alphabet, len(inside)) + len(_SYMBOLS)
        other = codes[rng.choice(np.flatnonzero(y == 0))]
        after = BEFORE + np.count_nonzero(other >= len(_SYMBOLS))
        parts = np.concatenate((other[:BEFORE], row[inside], other[after : after + AFTER], np.zeros(SPAN, row.dtype)))
        moved.append(np.where(np.arange(SPAN) < BEFORE + len(inside) + AFTER, parts[:SPAN], 0))
    shown = np.concatenate((codes, drawn, np.array(moved, dtype=codes.dtype).reshape(-1, SPAN)))
    known = np.concatenate((y, np.ones(len(shown) - len(y), y.dtype)))
    some = rng.random(len(shown)) < 0.5
    hidden = np.where(shown >= len(_SYMBOLS), shown, 0)[some]
    return np.concatenate((shown, hidden)), np.concatenate((known, known[some]))


def _fold(text: Column) -> Column:
    """Documents by text, so that copies share a fold; fold 0 calibrates."""
    return F.pmod(F.xxhash64(text, F.lit("fold")), F.lit(5)) == 0


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of the smallest ``h``; a count of leading bits cuts off the others first, so that no more than about ``n`` are ever gathered."""
    lead = F.shiftright("h", 51)  # 4096 values
    counts = sorted(tuple(r) for r in rows.groupBy(lead.alias("lead")).count().collect())
    total, most = 0, None
    for value, count in counts:
        total, most = total + count, value
        if total >= n:
            break
    return rows.filter(lead <= F.lit(most)).orderBy("h", "codes").limit(n)


def fit_network(docs: DataFrame, text: str = "text", per_class: int = 1500, rounds: int = 12) -> CharNetwork:
    """Learn from at most ``per_class`` findings and twice as many ordinary candidates; they are all that the driver sees."""
    bounds = (2 * per_class, per_class)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[int, tuple[str, int]]] = [{}, {}]
        cut = [1 << 64, 1 << 64]
        for batch in batches:
            for t in batch.column(0).to_pylist():
                runs = candidates(t)
                if not runs:
                    continue
                strings, inside, of = windows(t, runs)
                known = touched(runs, base_spans(t))
                for s, n, k in zip(strings, inside, of, strict=True):
                    y = int(known[k])
                    h = xxh64_intdigest(s.encode("utf-8", "surrogatepass"), n)
                    if h < cut[y]:
                        held[y][h] = s, n
                        if len(held[y]) > 4 * bounds[y]:
                            held[y] = dict(sorted(held[y].items())[: bounds[y]])
                            cut[y] = max(held[y])
        for y in (0, 1):
            rows = sorted(held[y].items())[: bounds[y]]
            codes = encoded([s for _, (s, _) in rows], [n for _, (_, n) in rows]) if rows else np.zeros((0, SPAN), np.int16)
            yield pa.RecordBatch.from_arrays([
                pa.array([y] * len(rows), pa.int32()), pa.array([h >> 1 for h, _ in rows], pa.int64()), pa.array([c.astype("<i2").tobytes() for c in codes], pa.binary()),
            ], names=["y", "h", "codes"])

    source = docs.filter(F.col(text).isNotNull() & ~_fold(F.col(text))).select(F.col(text).alias("_text"))
    taken = written(source.mapInArrow(sample, "y int, h long, codes binary").dropDuplicates(), "windows")
    codes = [[r[0] for r in _smallest(taken.filter(F.col("y") == y), bounds[y]).select("codes").collect()] for y in (0, 1)]
    if not codes[0] or not codes[1]:
        return CharNetwork()
    x = np.frombuffer(b"".join(codes[0] + codes[1]), dtype="<i2").reshape(-1, SPAN)
    y = np.repeat([0, 1], [len(codes[0]), len(codes[1])])
    # Keys that no pattern knows stand among the ordinary ones: what a first, short training takes for findings is left out,
    # if it has digits beside letters, as words have not.
    first = _trained(*_varied(x, y), max(1, rounds // 4))
    inside = np.where(x >= len(_SYMBOLS), x - len(_SYMBOLS), 0)
    digit = (inside >= _SYMBOLS.index("0")) & (inside <= _SYMBOLS.index("9"))
    letter = (inside >= _SYMBOLS.index("a")) & (inside <= _SYMBOLS.index("Z"))
    plain = (first.window_logits(x) < 0) | ~(digit.any(axis=1) & letter.any(axis=1))
    if plain[y == 0].mean() > 0.9:
        x, y = x[plain | (y == 1)], y[plain | (y == 1)]
    return _trained(*_varied(x, y), rounds)


_SPANS = "array<struct<start:int,kind:int,end:int>>"
_RUNS = "array<struct<start:int,end:int,logit:float,bare:float>>"


def scored_candidates(docs: DataFrame, network: CharNetwork, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the base spans, every candidate with its logit, and whether the text is of the calibration fold; written.

    Findings also have the logit that they get without their surroundings; it is null for ordinary candidates.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(*keep, _fold(content).alias("_fold"), content.alias("_scanned"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, runs, known = [], [], []
            held: list[tuple[list, list, list]] = [([], [], []), ([], [], [])]  # windows as they stand, and those of findings without surroundings
            sizes = [0, 0]
            for t in batch.column(batch.num_columns - 1).to_pylist():
                spans.append(base_spans(t))
                runs.append(candidates(t))
                known.append(touched(runs[-1], spans[-1]))
                for bare, some in enumerate((runs[-1], [r for r, k in zip(runs[-1], known[-1], strict=True) if k])):
                    for mine, own in zip(held[bare], windows(t, some, bool(bare)) if network.weights else ([], [], []), strict=True):
                        mine += own if mine is not held[bare][2] else [sizes[bare] + k for k in own]
                    sizes[bare] += len(some)
            logits, bares = (iter((network.logits(*h, n) if network.weights else np.full(n, -MOST_LOGIT)).tolist()) for h, n in zip(held, sizes, strict=True))
            listed = [[{"start": a, "end": b, "logit": next(logits), "bare": next(bares) if k else None} for (a, b), k in zip(r, y, strict=True)] for r, y in zip(runs, known, strict=True)]
            base = [[{"start": a, "kind": k, "end": b} for a, k, b in s] for s in spans]
            span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
            run = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("logit", pa.float32()), ("bare", pa.float32())])
            columns = [*batch.columns[:-1], pa.array(base, pa.list_(span)), pa.array(listed, pa.list_(run))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "_fold", "_base", "_runs"])

    return written(source.mapInArrow(scan, f"{schema}, _base {_SPANS}, _runs {_RUNS}"), "candidates")


def calibrated(network: CharNetwork, scored: DataFrame, recall: float = 0.95, unmarked: float = 0.001) -> CharNetwork:
    """Curve and threshold from the logits of all candidates of the calibration fold, or of all where the fold has no findings.

    The threshold keeps ``recall`` of the findings without surroundings. Where the
    classes lie apart it stands halfway down to the logit that a share
    ``unmarked`` of the ordinary candidates exceeds, as many as may be keys.
    """
    if not network.weights:
        return network
    known = F.col("r.bare").isNotNull()
    bin_of = F.round(F.coalesce("r.bare", "r.logit") / BIN).cast("int")
    rows = scored.select("_fold", F.explode("_runs").alias("r")).groupBy("_fold", known.alias("known"), bin_of.alias("bin")).count().collect()
    own = [r for r in rows if r["_fold"]]
    if {r["known"] for r in own} != {True, False}:
        own = rows
    zero = round(MOST_LOGIT / BIN)
    count = np.zeros((2, 2 * zero + 1))
    for r in own:
        count[int(r["known"]), r["bin"] + zero] += r["count"]
    if not count[0].sum() or not count[1].sum():
        return network
    at = (np.arange(count.shape[1]) - zero) * BIN
    above = count[:, ::-1].cumsum(axis=1)[:, ::-1]
    high = at[np.flatnonzero(above[1] >= recall * count[1].sum()).max()]
    low = at[np.flatnonzero(above[0] > unmarked * count[0].sum()).max()]
    return CharNetwork(network.weights, *_curve(at, count), float(high - max(0.0, high - low) / 2 - BIN / 2))


def _curve(at: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the counts, by Newton's method with a light pull to slope 1."""
    slope, shift = 1.0, 0.0
    n = count.sum(axis=0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * at + shift, -30, 30)))
        miss, spread = n * p - count[1], n * p * (1 - p)
        gradient = np.array([(miss * at).sum() + (slope - 1), miss.sum() + 0.01 * shift])
        curve = np.array([[(spread * at * at).sum() + 1, (spread * at).sum()], [(spread * at).sum(), spread.sum() + 0.01]])
        move = np.linalg.solve(curve, gradient)
        slope, shift = float(np.clip(slope - np.clip(move[0], -1, 1), 0.05, 20)), float(np.clip(shift - np.clip(move[1], -2, 2), -50, 50))
    return slope, shift


def find_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), per_class: int = 1500, recall: float = 0.95) -> DataFrame:
    """``keep``, ``_base`` (spans of the patterns) and ``_spans`` (these and the learned ones with their probability), both by start and kind."""
    network = fit_network(docs, text, per_class)
    scored = scored_candidates(docs, network, text, keep)
    network = calibrated(network, scored, recall)
    accepted = F.lit(False) if network.threshold is None else F.lit(True)
    cut = F.lit(network.threshold if network.threshold is not None else 0.0)
    learned = F.transform(
        F.filter("_runs", lambda r: accepted & r["bare"].isNull() & (r["logit"] >= cut)),
        lambda r: F.struct(r["start"], F.lit(KINDS.index("learned")).alias("kind"), r["end"], network.probability(r["logit"].cast("double")).alias("probability")),
    )
    base = F.transform("_base", lambda s: F.struct(s["start"], s["kind"], s["end"], F.lit(1.0).alias("probability")))
    return scored.select(*keep, "_base", F.sort_array(F.concat(base, learned)).alias("_spans"))


def span_text(spans: str | Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(found: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``find_secrets``' rows, whose ``keep`` holds the text, with each run of overlapping spans in it replaced by ``mark``; a null text stays null."""
    at = found.columns.index(text)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(at).to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                parts, upto = [], 0
                for s in spans:
                    if s["start"] >= upto:
                        parts += [t[upto : s["start"]], mark]
                    upto = max(upto, s["end"])
                out.append("".join([*parts, t[upto:]]) if parts else t)
            columns = [*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return found.mapInArrow(replace, found.schema)

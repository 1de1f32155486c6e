"""Language identification by interpolated Kneser-Ney character models, one per language.

Counts of character n-grams of the top order are made over all training texts; lower orders follow from
its types (continuation counts). All languages' probabilities lie side by side in arrays sorted by
n-gram hash, so one binary search serves all languages. A text gets the language of the least
cross-entropy per character; it is marked as rejected if that is beyond what training texts of the language show.
"""

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from .common import small_batches, stored, without

ORDER = 5
FEW_ROWS = 20
ENTROPY_STEPS = 1000  # a nat
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_M = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 21
TASK_GRAMS = 500_000
PACKED_ROWS = 1 << 18
MODEL_BYTES = 512 << 20  # arrays of a model that are sent to every worker; larger models stay tables
BUCKET_BITS = 18  # at least; a bucket holds about one hash in larger models too


def normalised(text: str) -> str:
    """Letters in lower case, everything else as single spaces, one at either end; empty if there is no letter."""
    plain = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    return plain if any(c.isalpha() for c in plain) else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def rolled(chars: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters from each place on."""
    n = max(0, len(chars) - order + 1)
    wide = chars.astype(np.uint64)
    h = np.full(n, np.uint64(order))
    for i in range(order):
        np.add(h, wide[i : i + n], out=h)
        np.multiply(h, _M, out=h)
    h ^= h >> np.uint64(29)
    np.multiply(h, _M, out=h)
    return h


class GramCounter:
    """Counts of one language's n-grams by hash, and a text of each."""

    def __init__(self, order: int):
        self.order = order
        self.texts: list[str] = []
        self.size = 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.known = np.zeros(0, np.uint64)
        self.grams: dict[int, str] = {}

    def add(self, text: str) -> None:
        self.texts.append(text)
        self.size += len(text)
        if self.size > CHUNK:
            self.count()

    def count(self) -> None:
        order, whole = self.order, "".join(self.texts)
        chars = codes(whole)
        usable = np.ones(len(chars), bool)
        for end in np.cumsum([len(t) for t in self.texts]).tolist():
            usable[max(0, end - order + 1) : end] = False
        self.texts, self.size = [], 0
        at = np.flatnonzero(usable[: max(0, len(chars) - order + 1)])
        hashes = rolled(chars, order)[at]
        ordered = np.sort(hashes)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        names, counts = ordered[first], np.diff(np.append(first, len(ordered)))
        fresh = np.setdiff1d(names, self.known, assume_unique=True)
        if len(fresh):
            place = np.minimum(np.searchsorted(fresh, hashes), len(fresh) - 1)
            new = np.flatnonzero(fresh[place] == hashes)
            found, one = np.unique(hashes[new], return_index=True)
            for h, i in zip(found.tolist(), at[new[one]].tolist()):
                self.grams[h] = whole[i : i + order]
            self.known = np.union1d(self.known, fresh)
        self.parts.append((names, counts))
        if sum(len(n) for n, _ in self.parts) > CHUNK:
            self.parts = [self.summed()]

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        names = np.concatenate([n for n, _ in self.parts])
        order = np.argsort(names, kind="stable")
        names, counts = names[order], np.concatenate([c for _, c in self.parts])[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
        return names[first], np.add.reduceat(counts, first) if len(first) else counts

    def frame(self, lang: str) -> pd.DataFrame:
        self.count()
        names, counts = self.summed()
        return pd.DataFrame({"lang": lang, "gram": [self.grams[h] for h in names.tolist()], "n": counts})


def count_grams(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) of all texts of (lang, text); each task sums its own before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, GramCounter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                counter = held.setdefault(lang, GramCounter(order))
                counter.add(normalised(text))
                if len(counter.grams) > TASK_GRAMS:
                    yield held.pop(lang).frame(lang)
        for lang, counter in held.items():
            yield counter.frame(lang)

    return rows.mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Arrays by order: hashes of known n-grams with a row of log probabilities, hashes of contexts with log weights of the lower order."""

    langs: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    limits: dict[str, float]
    limit_else: float = np.inf
    starts: dict[int, np.ndarray] = field(default_factory=dict, repr=False)

    def logs(self, chars: np.ndarray) -> np.ndarray:
        """Log probabilities (places, languages) of the last of each ``order`` characters."""
        return self._at(chars, np.arange(max(0, len(chars) - self.order + 1)), self.order)

    def _find(self, order: int, known: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes in a sorted array, by way of where each value of their upper bits starts."""
        if not len(known):
            return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        starts = self.starts.get(order)
        if starts is None:
            bits = max(BUCKET_BITS, len(known).bit_length())
            starts = np.searchsorted(known, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(64 - bits))
            starts[-1] = len(known)  # the last bound does not fit in 64 bits
            starts = self.starts[order] = starts.astype(np.int32)
        bits = (len(starts) - 1).bit_length() - 1
        bucket = (names >> np.uint64(64 - bits)).astype(np.int32)
        place = starts[bucket]
        end = starts[bucket + 1]
        last = len(known) - 1
        hit = (known[np.minimum(place, last)] == names) & (place < end)
        open_ = np.flatnonzero(~hit & (place + 1 < end))
        while len(open_):
            place[open_] += 1
            found = known[place[open_]] == names[open_]
            hit[open_[found]] = True
            rest = open_[~found]
            open_ = rest[place[rest] + 1 < end[rest]]
        return place, hit

    def _at(self, chars: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
        # ``ends`` are starts of top-order windows; a lower order looks at the last characters of them.
        shift = self.order - order
        if order == 0:
            return np.broadcast_to(self.floor, (len(ends), len(self.langs))).copy()
        known, values = self.grams[order]
        names = rolled(chars, order)[ends + shift]
        place, hit = self._find(order, known, names)
        out = np.empty((len(ends), len(self.langs)), np.float32)
        out[hit] = values[place[hit]]
        missed = np.flatnonzero(~hit)
        if len(missed):
            back = self._at(chars, ends[missed], order - 1)
            before, weights = self.contexts[order]
            names = rolled(chars, order - 1)[ends[missed] + shift]
            place = np.minimum(np.searchsorted(before, names), max(0, len(before) - 1))
            if len(before):
                seen = before[place] == names
                back[seen] += weights[place[seen]]
            out[missed] = back
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character (texts, languages) of normalised texts; empty ones get zeros."""
        sums, places = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            chars = np.concatenate([c for _, c in held])
            edges = np.cumsum([0, *[len(c) for _, c in held]])
            logs = self.logs(chars).astype(np.float64)  # sums of many small numbers
            bounds, owners = [], []
            for (text, own), a in zip(held, edges[:-1].tolist()):
                n = len(own) - self.order + 1
                if n > 0:
                    bounds += [a, a + n]
                    owners.append(text)
                    places[text] += n
            if owners:
                ends = bounds if bounds[-1] < len(logs) else bounds[:-1]
                np.add.at(sums, owners, np.add.reduceat(logs, ends, axis=0)[::2])
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            chars = codes(text if len(text) >= self.order else text and text.ljust(self.order))
            for a in range(0, len(chars), CHUNK):  # the parts of a long text overlap by what a window needs before it
                part = chars[max(0, a - self.order + 1) : a + CHUNK]
                held.append((i, part))
                size += len(part)
                if size > CHUNK // 2:
                    flush()
                    size = 0
        if held:
            flush()
        return -sums / np.maximum(places, 1)[:, None]

    def predict(self, texts: list[str]) -> list[tuple]:
        """(language, score, cross-entropy, rejected) of raw texts."""
        plain = [normalised(t) for t in texts]
        entropy = self.entropies(plain)
        best = entropy.argmin(axis=1) if self.langs else []
        out = []
        for i, text in enumerate(plain):
            if not text or not self.langs:
                out.append((UNKNOWN, 0.0, None, True))
                continue
            # Share of the best language if the text had 50 characters at most: longer ones are not surer than that.
            weight = np.exp(-(entropy[i] - entropy[i].min()) * min(50, len(text)))
            lang = self.langs[int(best[i])]
            out.append((lang, float(1 / weight.sum()), float(entropy[i].min()), bool(entropy[i].min() > self.limits.get(lang, self.limit_else))))
        return out

    def label(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """Add ``lang_pred`` (``und`` without a letter), ``score`` (0 to 1), ``entropy`` and ``rejected``; whole texts, no shuffle.

        Columns of these names are replaced.
        """
        small_batches(df.sparkSession, 512)
        names = ["lang_pred", "score", "entropy", "rejected"]
        kept = without(df, *names, "_language")
        sent = df.sparkSession.sparkContext.broadcast(self)  # MODEL_BYTES at most, see build_distributed

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield pd.DataFrame(sent.value.predict([t or "" for t in texts]), columns=names).astype({"entropy": float})

        found = pandas_udf(run, "lang_pred string, score double, entropy double, rejected boolean")(F.col(text_col))
        return kept.withColumn("_language", found).select(*[F.col(f"`{c}`") for c in kept.columns], *[F.col(f"_language.{n}").alias(n) for n in names])


@dataclass
class TableModel:
    """The same model as tables by order, (gram, p) and (context, weight), for any number of n-grams.

    Texts are scored by joins: their windows are counted by text, each distinct window is looked up once, and the
    log probabilities are summed up by text.
    """

    langs: list[str]
    order: int
    grams: list[DataFrame]
    contexts: list[DataFrame]
    floor: float
    limits: dict[str, float]
    limit_else: float = np.inf

    def windows(self, distinct: DataFrame) -> DataFrame:
        """(window, logs) of distinct windows: the longest known n-gram at its end, and the back-off weights above it."""
        found = distinct
        last = lambda n, size: F.substring("window", self.order - n + 1, size)
        for n in range(self.order, 0, -1):
            grams = self.grams[n].select(F.col("gram").alias(f"g{n}"), F.col("p").alias(f"p{n}"))
            contexts = self.contexts[n].select(F.col("context").alias(f"c{n}"), F.col("weight").alias(f"w{n}"))
            # Joined whether or not a longer one is known: null keys would all meet in one task.
            found = found.join(grams, last(n, n) == F.col(f"g{n}"), "left").join(contexts, last(n, n - 1) == F.col(f"c{n}"), "left").drop(f"g{n}", f"c{n}")

        def log(j: int) -> Column:
            out = F.lit(self.floor)
            for n in range(1, self.order + 1):
                weight = F.coalesce(F.log(F.col(f"w{n}")[j]), F.lit(0.0))
                out = F.coalesce(F.log(F.col(f"p{n}")[j]), weight + out)
            return out

        return found.select("window", F.array(*[log(j) for j in range(len(self.langs))]).alias("logs"))

    def label(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """As :meth:`Model.label`, with shuffles by window and by text. Frequent windows are split by AQE's skew join."""
        small_batches(df.sparkSession, 512)
        names = ["lang_pred", "score", "entropy", "rejected"]
        kept = stored(without(df, *names, "_language", "_row").withColumn("_row", F.monotonically_increasing_id()), "texts")
        order, each = self.order, range(len(self.langs))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row, text in zip(batch["_row"], batch["text"]):
                    plain = normalised(text or "")
                    padded = plain.ljust(order) if plain else ""
                    for a in range(0, max(0, len(padded) - order + 1), CHUNK):
                        part = padded[a : a + CHUNK + order - 1]
                        counted = pd.Series([part[i : i + order] for i in range(len(part) - order + 1)]).value_counts()
                        for b in range(0, len(counted), PACKED_ROWS):
                            piece = counted.iloc[b : b + PACKED_ROWS]
                            yield pd.DataFrame({"_row": row, "size": len(plain), "window": piece.index, "n": piece.to_numpy()})

        texts = kept.select("_row", F.col(text_col).cast("string").alias("text"))
        counted = stored(texts.mapInPandas(count, "_row long, size long, window string, n long"), "windows")
        logs = stored(self.windows(counted.select("window").distinct()), "window-logs")
        sums = counted.join(logs, "window").groupBy("_row").agg(
            F.max("size").alias("size"), F.array(*[-F.sum(F.col("n") * F.col("logs")[j]) / F.sum("n") for j in each]).alias("entropies")
        )
        least = F.array_min("entropies")
        weight = F.aggregate(F.transform("entropies", lambda e: F.exp(-(e - least) * F.least(F.lit(50), F.col("size")))), F.lit(0.0), lambda a, b: a + b)
        best = F.element_at(F.array(*[F.lit(x) for x in self.langs]), F.array_position("entropies", least).cast("int"))
        limits = F.create_map(*[F.lit(x) for pair in sorted(self.limits.items()) for x in pair]) if self.limits else F.lit(None).cast("map<string,double>")
        judged = sums.select("_row", best.alias("lang_pred"), (1 / weight).alias("score"), least.alias("entropy"))
        judged = judged.withColumn("rejected", F.col("entropy") > F.coalesce(F.try_element_at(limits, F.col("lang_pred")), F.lit(float(self.limit_else))))
        judged = judged.select("_row", F.struct(*names).alias("_language"))
        joined = kept.join(judged, "_row", "left")
        given = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "entropy": F.lit(None).cast("double"), "rejected": F.lit(True)}
        found = [F.coalesce(F.col(f"_language.{n}"), given[n]).alias(n) for n in names]
        return joined.select(*[F.col(f"`{c}`") for c in kept.columns if c != "_row"], *found)


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5


def build(counts: pd.DataFrame, order: int = ORDER) -> Model:
    """Kneser-Ney probabilities of all languages from top-order counts (lang, gram, n) that fit in memory; see :func:`build_distributed`."""
    langs = sorted(counts["lang"].unique())
    per_lang = [{g: int(n) for g, n in zip(part["gram"], part["n"])} for part in (counts[counts["lang"] == x] for x in langs)]
    by_order: list[list[dict[str, int]]] = [[] for _ in range(order + 1)]
    for top in per_lang:
        level = top
        for n in range(order, 0, -1):
            by_order[n].append(level)
            lower: dict[str, int] = {}
            for gram in level:
                lower[gram[1:]] = lower.get(gram[1:], 0) + 1
            level = lower
    letters = len({g for level in by_order[1] for g in level}) + 1
    floor = np.full(len(langs), -np.log(letters), np.float32)
    grams: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32))]
    contexts = [grams[0]]
    below: dict[str, np.ndarray] = {}
    for n in range(1, order + 1):
        totals, kinds, discounts = [], [], []
        for level in by_order[n]:
            total: dict[str, int] = {}
            kind: dict[str, int] = {}
            for gram, count in level.items():
                total[gram[:-1]] = total.get(gram[:-1], 0) + count
                kind[gram[:-1]] = kind.get(gram[:-1], 0) + 1
            ones, twos = sum(1 for c in level.values() if c == 1), sum(1 for c in level.values() if c == 2)
            totals.append(total)
            kinds.append(kind)
            discounts.append(_discount(ones, twos))
        before = sorted({c for total in totals for c in total})
        weights = np.ones((len(before), len(langs)))
        for j, (total, kind) in enumerate(zip(totals, kinds)):
            for i, c in enumerate(before):
                if c in total:
                    weights[i, j] = discounts[j] * kind[c] / total[c]
        weight_of = dict(zip(before, weights))
        names = sorted({g for level in by_order[n] for g in level})
        probabilities = np.empty((len(names), len(langs)))
        for i, gram in enumerate(names):
            low = below[gram[1:]] if n > 1 else np.full(len(langs), 1 / letters)
            row = weight_of[gram[:-1]] * low
            for j, level in enumerate(by_order[n]):
                count = level.get(gram)
                if count:
                    row[j] += (count - discounts[j]) / totals[j][gram[:-1]]
            probabilities[i] = row
        below = dict(zip(names, probabilities))
        grams.append(_sorted(names, np.log(probabilities)))
        contexts.append(_sorted(before, np.log(weights)))
    return Model(langs, order, grams, contexts, floor, {})


def _sorted(names: list[str], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.concatenate([rolled(codes(g), len(g)) if g else np.zeros(1, np.uint64) for g in names]) if names else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    return hashes[order], values[order].astype(np.float32)


def build_distributed(counts: DataFrame, order: int = ORDER, model_bytes: int | None = None) -> Model | TableModel:
    """The model of :func:`build`, made by Spark from all top-order counts (lang, gram, n).

    A row has an n-gram's counts in all languages side by side. If the arrays take ``model_bytes`` (MODEL_BYTES unless told)
    at most, the driver gets hashes and log probabilities, in packed pieces; a larger model stays in its tables.
    """
    model_bytes = MODEL_BYTES if model_bytes is None else model_bytes
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # one row per language
    each = range(len(langs))

    def of_each(make: Callable[[int], Column]) -> Column:
        return F.array(*[make(j) for j in each])

    seen = lambda j: (F.col("c")[j] > 0).cast("long")
    levels: dict[int, DataFrame] = {}
    for n in range(order, 0, -1):
        if n == order:
            level = counts.groupBy("gram").agg(of_each(lambda j: F.sum(F.when(F.col("lang") == langs[j], F.col("n")).otherwise(0))).alias("c"))
        else:
            level = levels[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(of_each(lambda j: F.sum(seen(j))).alias("c"))
        levels[n] = stored(level, f"grams-{n}") if langs else level
    letters = (levels[1].count() if langs else 0) + 1
    none = (np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32))
    if not langs:
        return Model([], order, [none] * (order + 1), [none] * (order + 1), np.zeros(0, np.float32), {})
    tables: list[tuple[DataFrame, DataFrame]] = []
    below = None
    for n in range(1, order + 1):
        level = levels[n].withColumn("context", F.substring("gram", 1, n - 1))
        rare = level.agg(*[F.count_if(F.col("c")[j] == k).alias(f"n{k}_{j}") for j in each for k in (1, 2)]).first()
        discounts = [_discount(rare[f"n1_{j}"], rare[f"n2_{j}"]) for j in each]
        contexts = level.groupBy("context").agg(of_each(lambda j: F.sum(F.col("c")[j])).alias("total"), of_each(lambda j: F.sum(seen(j))).alias("kinds"))
        weight = of_each(lambda j: F.when(F.col("total")[j] > 0, F.lit(discounts[j]) * F.col("kinds")[j] / F.col("total")[j]).otherwise(1.0))
        contexts = stored(contexts.select("context", "total", weight.alias("weight")), f"contexts-{n}")
        joined = level.join(contexts, "context")
        if below is not None:
            joined = joined.withColumn("lower", F.substring("gram", 2, n - 1)).join(below.select(F.col("gram").alias("lower"), F.col("p").alias("low")), "lower")
        low = lambda j: F.lit(1 / letters) if below is None else F.col("low")[j]
        own = lambda j: F.when(F.col("c")[j] > 0, (F.col("c")[j] - F.lit(discounts[j])) / F.col("total")[j]).otherwise(0.0)
        below = stored(joined.select("gram", of_each(lambda j: F.col("weight")[j] * low(j) + own(j)).alias("p")), f"probabilities-{n}")
        tables.append((below.select("gram", "p"), contexts.select("context", "weight")))
    rows = sum(t.count() for pair in tables for t in pair)
    if rows * (8 + 4 * len(langs)) > model_bytes:
        first = tables[0]  # stands at place 0, where no n-gram is
        return TableModel(langs, order, [first[0], *[g for g, _ in tables]], [first[1], *[c for _, c in tables]], float(-np.log(letters)), {})
    packed = [(_packed(g, len(langs)), _packed(c, len(langs))) for g, c in tables]
    floor = np.full(len(langs), -np.log(letters), np.float32)
    return Model(langs, order, [none, *[g for g, _ in packed]], [none, *[c for _, c in packed]], floor, {})


def _packed(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the first column with the logarithms of the second."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def piece() -> pd.DataFrame:
            names = [g for part in held for g in part.iloc[:, 0]]
            hashes, logs = _sorted(names, np.log(np.concatenate([np.stack(part.iloc[:, 1]) for part in held])))
            return pd.DataFrame({"hashes": [hashes.tobytes()], "logs": [logs.tobytes()]})

        for batch in batches:
            if len(batch):
                held.append(batch)
                size += len(batch)
            if size >= PACKED_ROWS:
                yield piece()
                held, size = [], 0
        if held:
            yield piece()

    pieces = rows.mapInPandas(run, "hashes binary, logs binary").toLocalIterator()
    both = [(np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["logs"], np.float32).reshape(-1, width)) for r in pieces]
    if not both:
        return np.zeros(0, np.uint64), np.zeros((0, width), np.float32)
    hashes = np.concatenate([h for h, _ in both])
    order = np.argsort(hashes)
    return hashes[order], np.concatenate([v for _, v in both])[order]


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, quantile: float = 0.999,
        model_bytes: int | None = None) -> Model | TableModel:
    """Learn from all rows with a text and a language for which ``learn`` holds.

    Counts cover every such text and the model keeps every n-gram of them: 8 bytes and 4 more per language for each n-gram
    and context. Up to ``model_bytes`` (MODEL_BYTES unless told) it is sent to all executors as arrays; a larger one
    stays a set of tables that texts are joined with, with the same results. Rejection limits are those of
    :func:`calibrated`, over every training text.
    """
    rows = _training(docs, learn, text_col, lang_col)
    model = _uncalibrated(rows, order, model_bytes)
    if model.langs:
        calibrated(model, stored(model.label(rows).select("lang", "lang_pred", "entropy"), "entropies"), quantile)
    return model


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
             quantile: float = 0.999, model_bytes: int | None = None) -> DataFrame:
    """(id, lang_pred, score, entropy, rejected) of every row, as ``fit(docs, learn).label(docs)`` gives them, with each text scored once."""
    model = _uncalibrated(_training(docs, learn, text_col, lang_col), order, model_bytes)
    taught = F.coalesce(learn, F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    rows = docs.select(F.col(id_col).alias("_id"), F.when(taught, F.col(lang_col)).alias("lang"), F.col(text_col).alias("text"))
    scored = stored(model.label(rows).select("_id", "lang", "lang_pred", "score", "entropy", "rejected"), "entropies")
    rejected = F.col("rejected")
    if model.langs:
        calibrated(model, scored.filter("lang IS NOT NULL"), quantile)
        known = F.create_map(*[F.lit(x) for pair in sorted(model.limits.items()) for x in pair]) if model.limits else F.lit(None).cast("map<string,double>")
        rejected = F.col("entropy").isNull() | (F.col("entropy") > F.coalesce(known[F.col("lang_pred")], F.lit(model.limit_else)))
    return scored.select(F.col("_id").alias(id_col), "lang_pred", "score", "entropy", rejected.alias("rejected"))


def _training(docs: DataFrame, learn: Column, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.filter(learn).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.filter("lang IS NOT NULL AND text IS NOT NULL")


def _uncalibrated(rows: DataFrame, order: int, model_bytes: int | None = None) -> Model | TableModel:
    small_batches(rows.sparkSession, 512)
    return build_distributed(stored(count_grams(rows, order), "grams"), order, model_bytes)


def calibrated(model: Model | TableModel, scored: DataFrame, quantile: float) -> None:
    """Set the rejection limits from (lang, lang_pred, entropy) of all training rows.

    A language's limit is the least step of 1 / ENTROPY_STEPS that ``quantile`` of its rightly labelled rows do not
    exceed. A language with fewer than FEW_ROWS of them gets the limit over all rows of all languages.
    """
    step = F.ceil(F.col("entropy") * ENTROPY_STEPS)
    right = F.col("lang") == F.col("lang_pred")
    # A few thousand steps per language, combined before the shuffle.
    steps = stored(scored.filter("entropy IS NOT NULL").groupBy(F.col("lang_pred").alias("by"), step.alias("step")).agg(F.count("*").alias("n"), F.count_if(right).alias("right")), "entropy-steps")
    pooled = steps.groupBy("step").agg(F.sum("n").alias("n")).withColumn("by", F.lit(None).cast("string"))
    both = steps.filter("right > 0").select("by", "step", F.col("right").alias("n")).unionByName(pooled.select("by", "step", "n"))
    group = Window.partitionBy("by")
    upto = F.sum("n").over(group.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumns({"upto": upto, "all": F.sum("n").over(group)})
    found = placed.filter(F.col("upto") >= F.col("all") * quantile).groupBy("by").agg(F.min("step").alias("step"), F.first("all").alias("n")).collect()  # one row per language
    model.limits = {r["by"]: r["step"] / ENTROPY_STEPS for r in found if r["by"] is not None and r["n"] >= FEW_ROWS}
    model.limit_else = next((r["step"] / ENTROPY_STEPS for r in found if r["by"] is None), np.inf)

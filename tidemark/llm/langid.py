"""Language identification by interpolated Kneser-Ney character models.

Each language has a model over character n-grams up to ORDER with interpolated Kneser-Ney
smoothing. N-grams are 64-bit hashes in sorted arrays; all languages share one array per order whose
rows hold each language's log-probability, so a text is looked up once for all of them. The language
of least cross-entropy per character wins. A text is rejected when its cross-entropy lies far above
what held-out texts of that language show.

The models are fitted on a bounded sample of labelled rows (see ``fit``); every text is scored whole.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tidemark.llm.common import HOT_KEYS, cut, narrow_batches

ORDER = 4
DISCOUNT = 0.75
#: What the fit reads: of each language about so many labelled rows (twice as many at most), and no further row after so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 2_000_000
#: Characters of all languages together: with more than 32 languages each gets less than SAMPLE_CHARS.
ALL_CHARS = 64_000_000
#: Bytes of the models, which go to every task. More are an error.
MODEL_BYTES = 1 << 30
#: Nats beyond the limit that a text must cost in all to be rejected: a key or a typing slip in a short text costs less.
EVIDENCE = 100.0
#: Hash multiplier. Any odd number will do.
MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 18

_folded: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or blank for what is no letter."""
    if not _folded:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded.append(table)
    return _folded[0]


def folded(text: str) -> np.ndarray:
    """Letters in lower case, with one blank before, between and after words."""
    codes = fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])
    blank = codes == 32
    return codes[~(blank & np.concatenate([[False], blank[:-1]]))]


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each position from n - 1 on."""
    h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        h = (h ^ codes[k : len(codes) - n + 1 + k].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Models:
    languages: list[str]
    keys: list[np.ndarray]  # for each order, sorted hashes
    logs: list[np.ndarray]  # for each order, a row of log-probabilities, one for each language
    unseen: np.ndarray  # log-probability of an unknown character
    backoff_keys: list[np.ndarray]  # contexts of each order from 1 on
    backoff: list[np.ndarray]  # log of the mass left to lower orders
    limits: np.ndarray  # cross-entropy beyond which a text is rejected

    def entropy(self, codes: np.ndarray) -> np.ndarray:
        """Cross-entropy per character under each language; codes: at least two characters."""
        total = np.zeros(len(self.languages))
        # Chunks overlap by the context, so every character is predicted once.
        for at in range(1, len(codes), CHUNK):
            part = codes[max(0, at - ORDER + 1) : at + CHUNK]
            total += self._sum(part, at - max(0, at - ORDER + 1))
        return -total / (len(codes) - 1)

    def _sum(self, codes: np.ndarray, start: int) -> np.ndarray:
        """Sum of log-probabilities of codes[start:]."""
        total = np.zeros(len(self.languages))
        todo = np.arange(start, len(codes))
        for n in range(ORDER, 0, -1):
            fits = todo[todo >= n - 1]
            found = np.zeros(len(todo), bool)
            if len(fits):
                h = grams(codes, n)[fits - (n - 1)]
                at = np.minimum(np.searchsorted(self.keys[n - 1], h), len(self.keys[n - 1]) - 1)
                hit = self.keys[n - 1][at] == h
                total += self._rows(self.logs[n - 1], at[hit])
                found[todo >= n - 1] = hit
                missed = fits[~hit]
                if n > 1 and len(missed):
                    c = grams(codes, n - 1)[missed - (n - 1)]
                    at = np.minimum(np.searchsorted(self.backoff_keys[n - 2], c), len(self.backoff_keys[n - 2]) - 1)
                    total += self._rows(self.backoff[n - 2], at[self.backoff_keys[n - 2][at] == c])
            todo = todo[~found]
            if not len(todo):
                return total
        return total + len(todo) * self.unseen

    @staticmethod
    def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of the table's rows at; rows that repeat are counted first."""
        return np.bincount(at, minlength=len(table)).astype(np.float64) @ table if len(at) * 4 > len(table) else table[at].sum(axis=0, dtype=np.float64)


def counted(texts: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Of each order n: n-grams (keys), their first and last n - 1 characters (contexts, lows), and counts: raw at the highest order, else of distinct characters before."""
    out = {}
    for n in range(1, ORDER + 1):
        rows = []
        for t in texts:
            if len(t) < n:
                continue
            h = grams(t, n)
            ends = grams(t, n - 1) if n > 1 else np.zeros(len(h) + 1, np.uint64)
            longer = h if n == ORDER else grams(t, n + 1)
            # Below the highest order, an n-gram at the beginning has nothing before it.
            at = 0 if n == ORDER else 1
            rows.append(np.stack([longer, h[at:], ends[at:-1], ends[at + 1 :]]))
        longer, h, context, low = np.concatenate(rows, axis=1) if rows else np.empty((4, 0), np.uint64)
        first = np.arange(len(h)) if n == ORDER else np.unique(longer, return_index=True)[1]
        keys, at, counts = np.unique(h[first], return_index=True, return_counts=True)
        out |= {f"keys{n}": keys, f"contexts{n}": context[first][at], f"lows{n}": low[first][at], f"counts{n}": counts}
    return out


def _merged(models: dict[str, dict[str, np.ndarray]], limits: dict[str, float]) -> Models:
    """One table of n-grams for the languages counted; an n-gram that one language lacks has there what backing off gives."""
    languages = sorted(x for x in models if len(models[x]["keys1"]))
    if not languages:
        none = [np.empty(0, np.uint64)] * ORDER
        return Models([], none, [np.empty((0, 0))] * ORDER, np.empty(0), none[1:], [np.empty((0, 0))] * (ORDER - 1), np.empty(0))
    table, logs, backoff_keys, backoff = [], [], [], []
    for n in range(1, ORDER + 1):
        keys, first = np.unique(np.concatenate([models[x][f"keys{n}"] for x in languages]), return_index=True)
        table.append((keys, *(np.concatenate([models[x][f"{c}{n}"] for x in languages])[first] for c in ("contexts", "lows"))))
        if n > 1:
            backoff_keys.append(np.unique(np.concatenate([models[x][f"contexts{n}"] for x in languages])))
        logs.append(np.zeros((len(keys), len(languages))))
    size = sum(x.nbytes for x in logs)
    if size > MODEL_BYTES:
        raise ValueError(f"models of {len(languages)} languages take {size} bytes, more than {MODEL_BYTES}")
    backoff = [np.zeros((len(k), len(languages))) for k in backoff_keys]
    unseen = np.zeros(len(languages))
    for j, x in enumerate(languages):
        lower = np.zeros(0)
        for n, (keys, contexts, lows) in enumerate(table):
            own, ctx, c = (models[x][f"{k}{n + 1}"] for k in ("keys", "contexts", "counts"))
            if n == 0:
                # A language's letters and one that stands for all others share what the discount leaves.
                left = DISCOUNT * len(own) / c.sum() / (len(own) + 1)
                p = np.full(len(keys), left)
                p[np.searchsorted(keys, own)] += np.maximum(c - DISCOUNT, 0) / c.sum()
                unseen[j] = np.log(left)
            else:
                rows, inverse = np.unique(ctx, return_inverse=True)
                total = np.bincount(inverse, weights=c)
                known = backoff_keys[n - 1]
                gamma = np.ones(len(known))
                gamma[np.searchsorted(known, rows)] = DISCOUNT * np.bincount(inverse) / total
                backoff[n - 1][:, j] = np.log(gamma)
                before = table[n - 1][0]
                at = np.minimum(np.searchsorted(before, lows), len(before) - 1)
                p = gamma[np.searchsorted(known, contexts)] * np.where(before[at] == lows, lower[at], np.exp(unseen[j]))
                p[np.searchsorted(keys, own)] += np.maximum(c - DISCOUNT, 0) / total[inverse]
            logs[n][:, j] = np.log(p)
            lower = p
    return Models(languages, [t[0] for t in table], logs, unseen, backoff_keys, backoff, np.array([limits[x] for x in languages]))


def _single(texts: list[np.ndarray]) -> Models:
    return _merged({"": counted([t for t in texts if len(t) > ORDER])}, {"": np.inf})


def learned(texts: list[str]) -> tuple[dict[str, np.ndarray], float]:
    """Counts of one language, and its rejection limit. Every tenth text only calibrates the limit; of fewer than ten each does in turn."""
    parsed = [c for c in map(folded, texts) if len(c) > ORDER]
    train = [c for i, c in enumerate(parsed) if i % 10 != 9 or len(parsed) < 10]
    if len(parsed) >= 10:
        model = _single(train)
        held = [float(model.entropy(c)[0]) for i, c in enumerate(parsed) if i % 10 == 9]
    else:
        held = _left_out(parsed)
    seen = np.array(held)
    # Far beyond any text of the language: junk shares few of its n-grams.
    return counted(train), max(seen.mean() + 6 * seen.std(), 1.5 * seen.max()) if held else np.inf


def _left_out(texts: list[np.ndarray]) -> list[float]:
    """Cross-entropy of each text, or of each half of an only one, under a model of the others."""
    if len(texts) == 1:
        middle = len(texts[0]) // 2
        texts = [t for t in (texts[0][:middle], texts[0][middle:]) if len(t) > 1]
    out = []
    for i, c in enumerate(texts):
        others = _single(texts[:i] + texts[i + 1 :])
        if others.languages:
            out.append(float(others.entropy(c)[0]))
    return out


def fit(samples: dict[str, list[str]]) -> Models:
    """Models from texts by language."""
    found = {x: learned(t) for x, t in samples.items()}
    return _merged({x: f[0] for x, f in found.items()}, {x: f[1] for x, f in found.items()})


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(lang, place, text): about ``rows`` whole texts of each lang value, drawn by a hash of doc_id and text.

    At most twice as many of a language, and none after ``chars`` characters of it (fewer if there are many languages). Equal rows count once.
    """
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = cut(known.groupBy("lang").agg(F.count("*").alias("n")))
    share = counts.agg(F.greatest(F.count("*"), F.lit(1)).alias("languages"))
    limit = (counts.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS
    # Rows of the languages with most rows, HOT_KEYS at most, are drawn where they are read.
    hot, cold = F.broadcast(counts.where(F.col("n") > limit)), counts.where(F.col("n") <= limit)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    met = known.join(hot, "lang").unionByName(known.join(hot, "lang", "left_anti").join(cold, "lang"))
    drawn = met.where(draw < F.lit(float(rows)) / F.col("n")).select("lang", draw.alias("draw"), "text").distinct()
    in_order = Window.partitionBy("lang").orderBy("draw", "text")
    placed = drawn.withColumns({"place": F.row_number().over(in_order), "before": F.coalesce(F.sum(F.length("text")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    most = F.least(F.lit(chars), F.lit(ALL_CHARS) / F.col("languages"))
    return placed.crossJoin(F.broadcast(share)).where((F.col("place") <= 2 * rows) & (F.col("before") < most)).select("lang", "place", "text")


def _learned(pdf: pd.DataFrame) -> pd.DataFrame:
    """One language: its counts as arrays in one binary."""
    counts, limit = learned(pdf.sort_values("place")["text"].tolist())
    held = io.BytesIO()
    np.savez(held, **counts)
    return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "limit": [limit], "counts": [held.getvalue()]})


def fit_documents(docs: DataFrame) -> Models:
    """Models from ``labelled_sample``: each language is counted in a task; only its arrays come to the driver, some MB each."""
    found = labelled_sample(docs).groupBy("lang").applyInPandas(_learned, "lang string, limit double, counts binary").collect()
    arrays = {r["lang"]: dict(np.load(io.BytesIO(r["counts"]))) for r in found}
    return _merged(arrays, {r["lang"]: r["limit"] for r in found})


def _predicted(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: Models = shared.value
        for batch in batches:
            names, scores, rejected = [], [], []
            for text in batch.column("text"):
                codes = folded(text.as_py() or "")
                if len(codes) < 2 or not models.languages:
                    names.append("und")
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                h = models.entropy(codes)
                best = int(h.argmin())
                # Evidence of the whole text, bounded so that long texts don't saturate at once.
                odds = np.exp(-(h - h[best]) * min(len(codes) - 1, 200))
                names.append(models.languages[best])
                scores.append(float(1 / odds.sum()))
                rejected.append(bool((h[best] - models.limits[best]) * (len(codes) - 1) > EVIDENCE))
            out = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *PREDICTED])

    return predict


#: Columns that predictions add.
PREDICTED = ("__tidemark_lang_pred", "__tidemark_score", "__tidemark_rejected")


def with_language(docs: DataFrame, models: Models) -> DataFrame:
    """All columns of docs, and PREDICTED: the columns of ``predict`` under names that clash with none."""
    narrow_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in zip(PREDICTED, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]])
    return docs.mapInArrow(_predicted(shared), schema)


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score, rejected, one row for each row.

    lang_pred is 'und' for a null text, one without letters, or when no language was learned; such
    texts have score 0 and are rejected. score: the winner's share of evidence, from 0 to 1.
    """
    names, scores, rejected = PREDICTED
    found = with_language(docs.select("doc_id", "text"), models)
    return found.select("doc_id", F.col(names).alias("lang_pred"), F.col(scores).alias("score"), F.col(rejected).alias("rejected"))


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def identify(docs: DataFrame) -> DataFrame:
    """Fit on rows that are not held out (crc32 of doc_id as text, mod 3, is not 1) and predict every row.

    Columns: doc_id, held_out, lang_pred, score, rejected. A null doc_id counts as empty text there. Repeated rows
    get equal results. Texts are scored whole, however long. Empty table: empty result. Other columns are ignored.
    """
    models = fit_documents(docs.where(~held_out()))
    return predict(docs, models).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")

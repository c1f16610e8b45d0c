"""License scans, fill-in-the-middle and vector codes against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_text_operators import docs, empty, real, rows_of  # noqa: F401
from tidemark.llm import codes, fim, licenses

# -- licenses


def plain_words(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain_scan(text: str | None, templates=licenses.TEMPLATES, threshold: float = licenses.THRESHOLD) -> tuple:
    """Every block against every template, without any filter."""
    w = plain_words(text)
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    more, score = set(), 0.0
    for t in templates:
        tw = plain_words(t.text)
        tokens = set(zip(tw, tw[1:], strict=False))
        half = next(x for x in licenses.WIDTHS if x // 2 >= len(tw)) // 2
        for begin in range(0, max(1, len(w)), half):
            block = w[begin : begin + 2 * half]
            both = len(tokens & set(zip(block, block[1:], strict=False)))
            if both >= math.ceil(threshold * len(tokens) - 1e-9):
                more.add(t.label)
                score = max(score, both / len(tokens))
    first, last = (min(places), max(places)) if places else (None, None)
    return len(w), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), round(score, 9)


def scanned(df, **more) -> list[tuple]:
    return [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in rows_of(licenses.license_scan(df, **more))]


def license_texts() -> list[str]:
    rng = random.Random(5)
    filler = ["the", "license", "mit", "under", "of", "software", "public", "general", "a", "b", "naïve", "4", "0", "cc", "by"]
    out = [None, "", " \n", "MIT", "MIT License mit-license MIT  license", "General Public License", "general public\nLICENSE", "Apache license mit license"]
    for t in licenses.TEMPLATES:
        for edits in (0, 1, 2, 5):
            w = t.text.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(filler)
            before = [rng.choice(filler) for _ in range(rng.choice((0, 3, 15, 16, 17, 300)))]
            out.append(" ".join([*before, *w, *rng.choices(filler, k=rng.choice((0, 2, 40)))]))
    return out


def test_license_scan_equals_every_block_against_every_template(spark, real):  # noqa: F811
    texts = license_texts()
    data = spark.createDataFrame([(i % 60 if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    want = [(r.doc_id, *plain_scan(r.text)) for r in data.collect()]
    assert sorted(scanned(data), key=key) == sorted(want, key=key)
    assert sum(r[-1] > 0 for r in want) > 20 and any(0.9 <= r[-1] < 1 for r in want)
    assert sorted(scanned(real)) == sorted((r.doc_id, *plain_scan(r.text)) for r in real.collect())


def test_license_scan_with_a_low_threshold(spark):
    data = spark.createDataFrame(list(enumerate(license_texts())), "doc_id long, text string")
    assert sorted(x[1:] for x in scanned(data, threshold=0.4)) == sorted(((*plain_scan(r.text, threshold=0.4),) for r in data.collect()))


def test_license_scan_of_hostile_rows(docs, empty):  # noqa: F811
    got = rows_of(licenses.license_scan(docs))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert licenses.license_scan(empty).count() == 0


def test_templates_are_bounded():
    with pytest.raises(ValueError):
        licenses.Index.of([licenses.Template("x", "word")])
    with pytest.raises(ValueError):
        licenses.Index.of([licenses.Template("x", " ".join(map(str, range(300))))])


# -- fill in the middle


def plain_fim(doc_id, text) -> tuple:
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    marked = any(m in text for m in ("<P>", "<S>", "<M>"))
    form = "plain" if not text or marked or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
    return n, form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


FIM = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_fill_in_middle_against_a_plain_version(spark, real):  # noqa: F811
    rng = random.Random(3)
    alphabet = ["a", "Zz", "word", " ", "\n", "<", ">", "P", "é", "😀", "<P", "S>", "1", "\x00"]
    texts = [None, "", "a", "😀", "<P>", "x<M>y", "a" * 5000, " " * 700, "ab " * 3000]
    texts += ["".join(rng.choices(alphabet, k=rng.choice((1, 2, 31, 32, 33, 64, 65, 400)))) for _ in range(300)]
    rows = [(None if i % 11 == 0 else i // 2, t) for i, t in enumerate(texts)]
    rows += rows[:40]  # rows that repeat
    data = spark.createDataFrame(rows, "doc_id long, text string")
    key = str
    assert sorted(((r["doc_id"], *(r[c] for c in FIM)) for r in rows_of(fim.fill_in_middle(data))), key=key) == sorted(((k, *plain_fim(k, t)) for k, t in rows), key=key)
    assert sorted((r["doc_id"], *(r[c] for c in FIM)) for r in rows_of(fim.fill_in_middle(real))) == sorted((r.doc_id, *plain_fim(r.doc_id, r.text)) for r in real.collect())


def test_outputs_are_texts_that_restore(spark, docs, empty):  # noqa: F811
    from pyspark.sql import functions as F

    out = fim.transformed(docs)
    assert out.where(~F.coalesce(fim.restored(F.col("form"), F.col("output")) == F.col("text"), F.lit(False))).count() == 0
    assert out.count() == docs.count() and fim.fill_in_middle(empty).count() == 0


def test_fill_in_middle_needs_no_python(real):  # noqa: F811
    plan = fim.fill_in_middle(real)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# -- vector codes


def plain_codes(rows: list[tuple]) -> tuple[list[tuple], str]:
    """rows(vec_id, vector, label) in order of vec_id -> (vec_id, code, error, label), digest."""
    x = np.array([[math.floor(1024 * v) for v in r[1]] for r in rows], np.int64).reshape(len(rows), 4, -1)
    book = x[:256].transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None, :] - book[None]) ** 2).sum(axis=3)
        own = d.argmin(axis=2)
        return own, np.take_along_axis(d, own[:, :, None], axis=2)[:, :, 0].sum(axis=1)

    for _ in range(4):
        own, _ = nearest()
        for p in range(4):
            for k in range(book.shape[1]):
                mine = own[:, p] == k
                if mine.any():
                    book[p, k] = x[mine, p].sum(axis=0) // mine.sum()
    own, error = nearest()
    return [(r[0], "".join(f"{c:02x}" for c in o), int(e), r[2]) for r, o, e in zip(rows, own, error, strict=True)], hashlib.sha256(",".join(map(str, book.ravel())).encode()).hexdigest()


def check_codes(spark, rows: list[tuple], kind: str = "float") -> None:
    data = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    kept = [r for r in rows if r[1] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want, digest = plain_codes([r for r in kept if len(r[1]) == len(kept[0][1])])
    by_label: dict = {}
    for _, _, e, label in want:
        by_label[label] = by_label.get(label, 0) + e
    got = rows_of(codes.compress(data))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=key) == sorted(((i, c, e, by_label[label]) for i, c, e, label in want), key=key)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def vectors(n: int, size: int, spread: float, seed: int) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, size))
    return (centers[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, size))).astype(np.float32).tolist()


def test_codes_against_every_distance(spark):
    rows = [(i, v, None if i % 5 == 0 else i % 3) for i, v in enumerate(vectors(900, 16, 0.3, 1))]
    rows += [(1000, None, 1), (1001, [1.0, None] * 8, 1), (1002, [float("nan")] * 16, 1), (1003, [float("inf")] * 16, 1), (1004, [], 2), (1005, [1.0] * 8, 2), (None, [0.5] * 16, 2)]
    rows += rows[:30] + [(7, [0.25] * 16, 1)]  # rows that repeat, one vec_id with two vectors
    check_codes(spark, rows)


def test_codes_of_ties_and_of_few_rows(spark):
    rng = np.random.default_rng(2)
    grid = (rng.integers(-2, 3, (700, 8)) / 1024).tolist()  # many equal parts and equal distances
    check_codes(spark, [(i, v, i % 4) for i, v in enumerate(grid)], "double")
    check_codes(spark, [(i, v, 0) for i, v in enumerate(vectors(5, 8, 1.0, 3))])
    check_codes(spark, [(0, [0.1] * 8, None)])


def test_codes_of_large_components_and_none(spark):
    check_codes(spark, [(i, [v * 1000 for v in x], 0) for i, x in enumerate(vectors(300, 8, 0.3, 4))], "double")
    got = rows_of(codes.compress(spark.createDataFrame([(1, [1e30] * 8, 1), (2, [-1e30] * 8, 1)], "vec_id long, embedding array<float>, label int")))
    assert len(got) == 2
    assert codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 60), st.sampled_from([1, 3, 1000]))
def test_bounds_never_lose_the_nearest_entry(seed, entries, size):
    """Bounds that went through 16 bits, over several moves of the codebook, against every distance; and they do save work."""
    rng = np.random.default_rng(seed)
    x, c = (rng.integers(-size, size + 1, (n, 4)) for n in (200, entries))
    group = codes.groups_of(c, 8)
    own, _, lows = codes.first_scan(x, c, group, int(group.max()) + 1)
    for _ in range(4):
        after = c + rng.integers(-1, 2, c.shape) * (rng.random((entries, 1)) < 0.3)
        drift = codes.drifts(c[None], after[None], group[None])[0]
        c = after
        own, error, lows, scanned = codes.bounded_scan(x, c, group, drift, own, codes._below(lows).astype(np.float64))
        d = codes.distances(x, c)
        assert (own == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_bounds_save_distances():
    x = np.floor(1024 * np.array(vectors(4000, 16, 0.05, 9))).astype(np.int64)
    c = x[:256]
    group = codes.groups_of(c)
    own, _, lows = codes.first_scan(x, c, group, int(group.max()) + 1)
    *_, scanned = codes.bounded_scan(x, c, group, np.zeros(int(group.max()) + 1), own, lows)
    assert scanned < 0.5 * len(x) * len(c)

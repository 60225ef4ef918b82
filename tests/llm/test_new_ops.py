"""Manifest, exact duplicates and importance resampling against brute force: nulls, ties, repeats, very long texts, none at all."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lapwing.llm import digestruns, merkle, resampling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, slot string, leaf string, size int, piece string, score string, range int"
LONG = "word salad with Ähren and more " * 1000
TEXTS = [None, "", "", " ", "Same Text", "same text", "SAME TEXT", "ÄRGER", "ärger", "İ", "i̇", LONG, LONG.upper().replace("Ä", "ä"), "x" * 100_000, *["one of very many copies"] * 60, *[f"text {k} " * (k % 40) for k in range(90)]]


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, n, "x", "y", "z", 1, "p", "q", 2) for d, t, lang, s, n in rows], DOCS)


def odd_rows():
    rows = [(k * 3 % 1009, t, [None, "en", "de"][k % 3], [None, "a", "", "Ä", "b"][k * k % 5], k if k % 4 else None) for k, t in enumerate(TEXTS)]
    return [*rows, (None, "same text", None, None, None), (None, "nobody else has this", "en", "a", 1), (3, "Same text", "en", "a", 2), (7, "x", "en", "one row only", 1), rows[-1], rows[-1]]


def az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("keep", "bits", "parts"), [("largest", None, 7), ("smallest", 1, 3), ("largest", 8, 1)])
def test_exact_duplicates(spark, keep, bits, parts):
    rows = odd_rows()
    got = digestruns.exact_duplicates(table(spark, rows).repartition(parts), keep, bits).collect()
    assert len(got) == len(rows)
    own = {}
    for d, t, *_ in rows:
        own.setdefault(sha(az(t)), []).append(d)
    best = {h: ((max if keep == "largest" else min)(x for x in ids if x is not None) if any(x is not None for x in ids) else None) for h, ids in own.items()}
    assert Counter((r.doc_id, r.text_sha256, r.keep_id, r.group_size) for r in got) == Counter((d, h, best[h], len(ids)) for h, ids in own.items() for d in ids)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(own) and all(r.doc_id == r.keep_id for r in kept) and {r.text_sha256 for r in kept} == set(own)
    assert digestruns.exact_duplicates(table(spark, rows).limit(0)).count() == 0


def brute_manifest(rows):
    def leaf(d, t, lang, s, n):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, s, lang, n, t)))

    def grow(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            yield run[: i % 16], run[i % 16 + 1 :]
            i //= 16

    groups = {}
    for r in rows:
        groups.setdefault((r[3] is not None, (r[3] or "").encode()), []).append(r)
    trees = [(sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))) for _, g in sorted(groups.items())]
    grown = [grow([leaf(*r) for r in g]) for g in trees]
    top = grow([t[-1][0] for t in grown])
    for k, (g, tree) in enumerate(zip(trees, grown, strict=True)):
        for i, (d, t, *rest) in enumerate(g):
            steps = [*path(tree, i), *path(top, k)]
            node = leaf(d, None if t is None else az(t), *rest) if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else tree[0][i]
            for left, right in steps:
                node = sha("".join([*left, node, *right]))
            yield d, tree[0][i], tree[-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in steps)), node, node == top[-1][0]


@pytest.mark.parametrize("pieces", [1, 5, 40])
def test_manifest(spark, monkeypatch, pieces):
    monkeypatch.setattr(merkle, "_pieces", lambda spark, rows: pieces)
    monkeypatch.setattr(merkle, "FAN", 3)
    rows = odd_rows() + [(5000 + k, f"t{k}", "en", "b", k) for k in range(300)] + [(9000 + k, "T", "en", f"s{k}", k) for k in range(40)]
    got = [tuple(r) for r in merkle.manifest(table(spark, rows)).collect()]
    key = lambda r: tuple(map(str, r))
    want = list(brute_manifest(rows))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_manifest_of_one_row_and_of_none(spark):
    one = [(7, "Some Text", None, "a", 9)]
    assert [tuple(r) for r in merkle.manifest(table(spark, one)).collect()] == list(brute_manifest(one))
    assert merkle.manifest(table(spark, one).limit(0)).count() == 0


def test_forest_is_associative_and_waits_for_few():
    rng = np.random.default_rng(3)
    nodes = [(t, n, i, sha(f"{t}-{i}")) for t, n in enumerate((1, 16, 17, 700, 4097)) for i in range(n)]
    parts = [nodes[a:b] for a, b in zip(*(lambda c: (c[:-1], c[1:]))([0, *sorted(rng.choice(len(nodes), 11, replace=False)), len(nodes)]), strict=True)]

    def forest(part):
        out = merkle.Forest(5)
        for t, n, i, h in part:
            out.add(t, n, 0, i, h)
        return out

    def waiting(f):
        return f.table().filter(~np.array(f.table().column("done").to_pylist(), bool))

    def merged(*forests):
        out = merkle.Forest(5)
        for f in forests:
            out.merge(waiting(f))
        return out

    assert all(sum(map(len, forest(p).waiting.values())) <= 30 * 5 for p in parts)
    roots = set()
    for order in (range(len(parts)), rng.permutation(len(parts)), rng.permutation(len(parts))):
        found = forest([])
        for k in order:
            found = merged(found, forest(parts[k]))
        assert not found.waiting
        roots.add(found.done[merkle.TOP, 1, 0][0])
    left, right = merged(*map(forest, parts[:6])), merged(*map(forest, parts[6:]))
    roots.add(merged(right, left).done[merkle.TOP, 1, 0][0])
    assert len(roots) == 1


def brute_draw(rows, target, percent, least, buckets, seed):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", az(t))
    feats = lambda w: [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(map(bucket, feats(words(text))))
    for text in target:
        t.update(map(bucket, feats(words(text))))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for d, text, *_ in rows:
        w = words(text)
        weight = sum(gain[bucket(f)] for f in feats(w))
        h = int(sha(f"{seed}:{'null' if d is None else d}")[:8], 16)
        out.append([d, len(feats(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("percent", "ranges"), [(5, 1), (40, 6), (100, 30), (0, 3)])
def test_resample(spark, monkeypatch, percent, ranges):
    monkeypatch.setattr(resampling, "_ranges", lambda spark, rows: ranges)
    rows = odd_rows() + [(2000 + k, f"alpha beta{k % 3} gamma {'delta ' * 9}" * 3, "en", "b", k) for k in range(60)]
    target = [None, "alpha beta gamma delta", "", "Text 5 text 5"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in resampling.resample(table(spark, rows).repartition(5), goal, percent=percent, buckets=997, seed=7).collect()), key=str)
    assert got == brute_draw(rows, target, percent, 20, 997, 7)


def test_resample_of_nothing(spark):
    goal = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(table(spark, odd_rows()).limit(0), goal).count() == 0
    got = resampling.resample(table(spark, odd_rows()[:1]), goal.limit(0)).collect()
    assert [tuple(r)[1:3] for r in got] == [(0, 0)] and got[0].rank is None


def test_pieces_of_a_long_text(monkeypatch):
    """Runs across pieces count once, whatever the length of a word."""
    monkeypatch.setattr(resampling, "SLICE", 64)
    monkeypatch.setattr("lapwing.llm.words.SLICE", 64)
    rng = np.random.default_rng(8)
    text = "".join(("Wört", " ", ".", "a" * int(rng.integers(1, 90)), ", ", "b")[k] for k in rng.integers(0, 6, 3000))
    rows = [(1, text), (2, "short one"), (3, "  .  " * 90 + text[:700]), (4, None), (5, "x" * 5000), (6, text[:5000])]
    batches = lambda: iter([pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in part], "text": [r[1] for r in part]}) for part in (rows[:4], rows[4:])])
    own = np.zeros(10_000, np.int64)
    for batch in resampling._counted(batches(), 10_000):
        own[batch.column("bucket").to_numpy()] = batch.column("n").to_numpy()
    target = np.zeros(10_000, np.int64)
    for f in ("a", "b", "a b"):
        target[zlib.crc32(f.encode()) % 10_000] += 1
    got = [tuple(r.values()) for batch in resampling._weighed(batches(), resampling.gains(own, target), 42) for r in batch.to_pylist()]
    want = brute_draw([(*r, None, None, None) for r in rows], ["a b"], 0, 20, 10_000, 42)
    assert sorted(((d, n, w, s, None) for d, _, n, w, s in got), key=str) == want and len(got) == 6


def test_checksums_and_tournament():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 3, 8, 63, 64, 65, 200, 5000)]
    data = np.frombuffer(b"".join(words), np.uint8)
    b = np.cumsum([len(w) for w in words])
    a = b - [len(w) for w in words]
    one = resampling.checksums(data, a, b)
    assert one.tolist() == [zlib.crc32(w) for w in words]
    two = resampling._joined(resampling._spaced(one[:-1]), one[1:], (b - a)[1:])
    assert two.tolist() == [zlib.crc32(x + b" " + y) for x, y in zip(words, words[1:], strict=False)]
    runs = [sorted((int(x), k) for x in rng.integers(0, 20, k)) for k in (0, 5, 1, 9, 0, 30, 2)]
    tree = resampling.Tournament([*runs])
    assert [tree.pop() for _ in range(47)] == sorted(x for r in runs for x in r)

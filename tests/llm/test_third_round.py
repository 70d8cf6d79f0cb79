"""Golay near duplicates, the Merkle manifest and collocations against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tillspark.llm import collocations, golay, manifest

SHAPE = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
         "`key` string, grp string, fingerprint int, n int, digest string")
WORDS = [f"w{k}" for k in range(60)]


def rows_of(texts: list[tuple]) -> list[tuple]:
    """Rows of (id, text, lang, source), beside columns whose names the operators use."""
    return [(i, t, g, s, None if t is None else len(t), "k", "g", 1, 2, "d")
            for i, t, g, s in texts]


def awkward() -> list[tuple]:
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = prose(400)
    near = base.split()
    near[200] = "other"
    texts = [base, base, " ".join(near), None, "", " \n\t", "One", "one", "two words",
             "A B c. d e\tf\x0bg, h i; a b c! a\x01 b a\x00 b", prose(30_000), "x" * 300_000,
             "élan vital élan\nvital", base.upper(), prose(50)]
    found = [(k, t, (None, "en", "und")[k % 3], (None, "", "s", "é")[k % 4])
             for k, t in enumerate(texts)]
    return [*found, found[0], found[3], (None, "no id", "en", "s"), (None, "no id", "en", "s"),
            (None, None, None, None), (-5, base, "en", "lone"), (7, "same id", "en", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(awkward()), SHAPE).repartition(3).cache()


# ---- near duplicates ---------------------------------------------------------------

def mark_of(text) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(marks: list[int]) -> list[int]:
    """Place of the first row that each row reaches over links of two bits or fewer."""
    parent = list(range(len(marks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    array = np.array(marks, np.uint64)
    for i in range(len(marks)):
        for j in np.flatnonzero(np.bitwise_count(array[i:i + 1] ^ array[:i]) <= 2):
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    return [find(k) for k in range(len(marks))]


def test_fingerprints_and_components(docs):
    rows = awkward()
    marks = [mark_of(t) for _, t, _, _ in rows]
    first = components_of(marks)
    least = defaultdict(list)
    for (i, *_), c in zip(rows, first, strict=True):
        if i is not None:
            least[c].append(i)
    want = Counter((i, f"{m:016x}", min(least[c], default=None))
                   for (i, *_), m, c in zip(rows, marks, first, strict=True))
    assert Counter(map(tuple, golay.near_duplicates(docs).collect())) == want
    assert golay.near_duplicates(docs.limit(0)).count() == 0


def test_golay_keys_meet_within_two_bits():
    code, rng = golay.Golay(), np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 4000)
    n_keys = np.bincount(code.keys(words)[0])
    assert set(n_keys) == {1, 6}
    for word in words[:400].tolist():
        own = set(code.keys(np.array([word]))[1].tolist())
        for n in range(3):
            flips = sum(1 << int(b) for b in rng.choice(23, n, replace=False))
            assert own & set(code.keys(np.array([word ^ flips]))[1].tolist())


@pytest.mark.parametrize("chunk", [512, 4])
def test_every_link_is_found(spark, monkeypatch, chunk):
    """Groups of fingerprints around a few centres, in whole and in cut buckets."""
    monkeypatch.setattr(golay, "CHUNK", chunk)
    rng, marks = random.Random(chunk), set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            marks.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    marks = sorted(marks)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    found = golay.links(spark.createDataFrame([(m,) for m in signed], "fingerprint bigint"))
    place = {m: k for k, m in enumerate(signed)}
    parent = list(range(len(marks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in found.collect():
        x, y = sorted((find(place[a]), find(place[b])))
        parent[y] = x
    assert [find(k) for k in range(len(marks))] == components_of(marks)


# ---- manifest --------------------------------------------------------------------------

def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and for each leaf the siblings left and right of its path."""
    steps, nodes, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[k:k + 3] for k in range(0, len(nodes), 3)]
        for k, place in enumerate(at):
            run = runs[place // 3]
            steps[k].append(("".join(run[:place % 3]), "".join(run[place % 3 + 1:])))
            at[k] = place // 3
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], steps


def manifest_of(rows: list[tuple]) -> Counter:
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0], leaf_of((r[0], r[3], r[2], r[4], r[1])), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree_of([x[1] for x in groups[s]])
    root, top = tree_of([trees[s][0] for s in order])
    out = Counter()
    for s, above in zip(order, top, strict=True):
        for (i, own, r), steps in zip(groups[s], trees[s][1], strict=True):
            bent = own
            if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and r[1] is not None:
                bent = leaf_of((i, s, r[2], r[4], r[1].replace("\n", "")))
            at = bent
            for left, right in steps + above:
                at = sha(left + at + right)
            proof = sha("".join(a + b for a, b in steps + above))
            out[i, own, trees[s][0], root, proof, at, at == root] += 1
    return out


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(docs, levels):
    """Blocks of three, of nine and of all documents give the same proofs."""
    got = manifest.verify(manifest.build(docs, levels=levels))
    assert Counter(map(tuple, got.collect())) == manifest_of(rows_of(awkward()))


def test_manifest_over_several_rounds(spark):
    rows = rows_of([(k, f"a\nb{k}", "en", "hot" if k % 3 else f"s{k % 7}") for k in range(700)])
    docs = spark.createDataFrame(rows, SHAPE).repartition(5)
    got = manifest.verify(manifest.build(docs, levels=2)).collect()
    assert Counter(map(tuple, got)) == manifest_of(rows)
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_little(spark, docs):
    assert manifest.verify(manifest.build(docs.limit(0))).count() == 0
    one = rows_of([(4, "x\n", None, None)])
    got = manifest.verify(manifest.build(spark.createDataFrame(one, SHAPE))).collect()
    assert Counter(map(tuple, got)) == manifest_of(one)
    assert got[0].leaf == got[0].subroot == got[0].root


def test_appended_witnesses_are_whole_at_any_time():
    tree = manifest.Appender(3)
    for k in range(14):
        tree.append(sha(str(k)))
    root, steps = tree_of([sha(str(k)) for k in range(14)])
    assert tree.close() == root and tree.witnesses == steps


# ---- collocations -------------------------------------------------------------------------

def collocations_of(texts: list[tuple], least: int, best: int) -> list[tuple]:
    sizes, counts = Counter(), Counter()
    small = {c: c + 32 for c in range(65, 91)}
    for lang, text in texts:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(small)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            counts.update((lang, tuple(words[i:i + k])) for k in range(1, 6)
                          for i in range(len(words) - k + 1))
    often = {p: n for p, n in counts.items() if n >= least}
    inside = defaultdict(int)
    for (lang, p), n in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i:i + k]] = max(inside[lang, p[i:i + k]], n)
    found = defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) > 1 and inside[lang, p] < a:
            cuts = [(often[lang, p[:k]], often[lang, p[k:]]) for k in range(1, len(p))]
            score, _, (l, r) = min((1000 * a * sizes[lang] // (x * y), k, (x, y))  # noqa: E741
                                   for k, (x, y) in enumerate(cuts))
            found[lang].append((score, a, " ".join(p), l, r, sizes[lang]))
    out = []
    for lang, rows in found.items():
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, k, p, a, l, r, n, s)
                for k, (s, a, p, l, r, n) in enumerate(rows[:best], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "best", "budget"), [(2, 2000, 1_000_000), (2, 2000, 3),
                                                       (3, 5, 40), (100, 2000, 200)])
def test_collocations(docs, least, best, budget):
    """With budgets so small that prefixes of up to five words are too heavy as well."""
    got = collocations.collocations(docs, least=least, best=best, budget=budget).collect()
    assert sorted(map(tuple, got)) == collocations_of(
        [(g, t) for _, t, g, _ in awkward()], least, best)


def test_collocations_with_hot_phrases(spark):
    rng = random.Random(8)
    texts = [("en", " ".join(rng.choice("a b c d e f g h".split()) for _ in range(60))
              + ". see the terms of use now") for _ in range(150)]
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(4)
    got = collocations.collocations(docs, budget=50).collect()
    assert sorted(map(tuple, got)) == collocations_of(texts, 100, 2000)
    assert {r.phrase for r in got if "terms" in r.phrase} == {"see the terms of use",
                                                              "the terms of use now"}


def test_no_collocations(docs):
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_exact_scores(spark):
    """Products beyond 64 bits."""
    a, l, r, n = 10**15 - 1, 10**15 + 7, 10**15 + 9, 10**16 + 61  # noqa: E741
    counts = spark.createDataFrame([(b"en\0a\0b", a), (b"en\0a", l), (b"en\0b", r)],
                                   "key binary, n bigint")
    words = spark.createDataFrame([(b"en\0a", n)], "key binary, n bigint")
    got = collocations.scored(counts, words).first()
    assert (got.a, got.l, got.r, got.n, got.score) == (a, l, r, n, 1000 * a * n // (l * r))

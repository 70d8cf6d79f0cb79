"""The whole pipeline on a small written table, each stage against plain Python."""

import random
import re

import pytest
import tokenizers

import corpus_pipeline
from tillspark.llm import queries

SHAPE = "doc_id bigint, source string, lang string, n_chars bigint, text string, `Text_Len` int"
RULES = [re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                    r"([A-Za-z0-9+/_.=-]+)"),
         re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")]
VOCABULARY = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "tu") for b in ("lan", "ver", "sti", "dro")
              for c in ("", "ing", "ed", "er", "al")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def made_rows():
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(60, 300)) for _ in range(60)]
    for k in range(0, 20, 4):
        own = texts[k].split()
        near = list(own)
        near[len(own) // 2] = "changed"
        texts += [texts[k], " ".join(near)]
    texts += ["too short", "", None, " \n\t", "again and again the same " * 40]
    texts += [prose(rng, 80) + f"\npassword = 'Zq8{k}xW2vLm9p' and AKIAABCDEFGHIJKLMN{k:02d} "
              + f"{rng.getrandbits(128):032x}\n" + prose(rng, 30) for k in range(6)]
    texts += [prose(rng, 4000), "漢字 é " + prose(rng, 70) + " <|endoftext|> it's"]
    rows = [(i, ["web", "books", "Code", None][i % 4], "en", len(t or ""), t, 7)
            for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "web", None, None, prose(rng, 90), None)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into the first stage and come out of each."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(made_rows(), SHAPE).repartition(3).write.parquet(
        f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == [c.split()[0].strip("`") for c in SHAPE.split(", ")]
    out["run"] = corpus_pipeline.run(spark, folder).collect()
    return out


def base_failed(text):
    found, at = words(text), {}
    for k in range(len(found) - 7):
        at.setdefault(tuple(found[k:k + 8]), []).append(k)
    again = {k + j for places in at.values() if len(places) > 1 for k in places for j in range(8)}
    return len(found) < 20 or 100 * len(again) > 30 * len(found)


def counted(rows):
    return sorted(map(repr, rows))


def test_quality_keeps_every_clean_row(stages):
    want = [r for r in stages["documents"] if not base_failed(r.text)]
    assert counted(stages["quality_rules"]) == counted(want)


def shingles(text):
    found = words(text)
    return {tuple(found[k:k + 5]) for k in range(max(1, len(found) - 4))}


def test_one_of_each_class_stays(stages):
    rows = stages["quality_rules"]
    sets, group = [shingles(r.text) for r in rows], list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    classes = {}
    for i, r in enumerate(rows):
        classes.setdefault(top(i), []).append(r)
    want = [min(c, key=lambda r: (r.doc_id is None, r.doc_id)) for c in classes.values()]
    assert len(want) < len(rows)
    assert counted(stages["near_duplicates"]) == counted(want)


def test_secrets_go_and_every_row_stays(stages):
    before = {r.doc_id: r for r in stages["near_duplicates"]}
    after = {r.doc_id: r for r in stages["secrets"]}
    assert len(stages["secrets"]) == len(stages["near_duplicates"]) and before.keys() == after.keys()
    n_marked = 0
    for i, r in after.items():
        text, spans = before[i].text, sorted(
            (m.start(), m.end()) for p in RULES for m in p.finditer(before[i].text)
            if len(m[0] if p.groups == 0 else m[1]) >= 6)
        want, at = "", 0
        for a, b in spans:
            if a >= at:
                want += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert r.text == want + text[at:] and r.n_chars == len(r.text)
        n_marked += bool(spans)
    assert n_marked == 6


def test_mixture_meets_its_budgets(stages):
    rows = stages["secrets"]
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, rest, free = {}, sum(sizes.values()), set(order)
    while free:
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            rest -= target[s]
            free.remove(s)
    taken, times = dict.fromkeys(order, 0), {}
    known = {repr(r) for r in rows}
    for r in stages["mixture"]:
        assert repr(r) in known
        taken[r.source] += len(words(r.text))
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3
    for s in order:
        assert abs(taken[s] - target[s]) <= max(len(words(r.text)) for r in rows if r.source == s)


def test_tokens_are_those_of_the_library(stages):
    library = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    texts = {r.doc_id: r.text for r in stages["mixture"]}
    assert len(stages["tokens"]) == len(stages["mixture"])
    for r in stages["tokens"]:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.round_trip


def test_run_gives_the_rows_of_the_stages(stages):
    assert counted(stages["run"]) == counted(stages["tokens"])


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], SHAPE).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"]

"""Secrets in very long texts, against plain Python, and names that are none."""

import hashlib
import random
import re
import string
import time

import pytest

from tillspark.llm import secret_scan

RULES = [
    ("assign", re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                          r"([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[1]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
SAFE = string.ascii_letters + string.digits


def base_of(text: str) -> list[tuple[int, int, int]]:
    return sorted((m.start(), k, m.end()) for k, (_, pattern, good) in enumerate(RULES)
                  for m in pattern.finditer(text or "") if good(m))


def piece(rng: random.Random) -> str:
    made = [lambda: "".join(rng.choice(SAFE) for _ in range(rng.randint(1, 40))),
            lambda: rng.choice(["password", "token", "API_KEY", "é"]) + rng.choice([" = ", ":", "='"]),
            lambda: "AKIA" + "".join(rng.choice("ABC09") for _ in range(rng.randint(10, 24))),
            lambda: "".join(rng.choice("09af") for _ in range(rng.randint(18, 40))),
            lambda: rng.choice([" ", "\n", ".", "plain words go here ", "漢"])]
    return rng.choice(made)()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    mixed = ["".join(piece(rng) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    mixed += ["".join(piece(rng) for _ in range(4000)), None, "", "x"]
    plain = ["the quick brown fox jumps over every lazy dog near a river bank"] * 3
    return [*mixed, *plain]


def test_base_spans_and_redaction(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in secret_scan.find(docs).collect()}
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    names = [n for n, _, _ in RULES]
    for i, text in enumerate(texts):
        base = base_of(text)
        want = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        assert found[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        spans = [(int(a), int(b)) for _, a, b in
                 (x.split(":") for x in found[i].spans.split(",") if x)]
        assert {(a, b) for a, _, b in base} <= set(spans)
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert clean[i] == (out + (text or "")[at:] if spans else text)


def test_long_tokens_and_many_matches_are_linear(spark):
    rng = random.Random(9)
    long = "".join(rng.choice(SAFE) for _ in range(1_000_000))
    many = " ".join(f"token={rng.getrandbits(48):013x}zz" for _ in range(100_000))
    docs = spark.createDataFrame([(1, f"data {long} end"), (2, many)], "doc_id bigint, text string")
    start = time.monotonic()
    rows = {r.doc_id: r for r in secret_scan.find(docs).select("doc_id", "n_assign").collect()}
    assert rows[2].n_assign == 100_000
    sizes = {r.doc_id: len(r.text) for r in secret_scan.redact(docs).collect()}
    assert sizes[2] == 100_000 * len("[SECRET]") + 99_999
    assert time.monotonic() - start < 60


def test_names_are_not_random(spark):
    rng = random.Random(2)
    words = ("service handler project example create default http client builder request the "
             "value of account manager file path render table column update window stream "
             "configuration component remote local server response system network").split()
    prose = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(200)]
    keys = ["token = " + "".join(rng.choice(SAFE) for _ in range(32)) for _ in range(60)]
    names = ["com_example_project_service_handler", "createDefaultHttpClientBuilder",
             "remote-server-response-system", "updateWindowTableColumnValue"]
    planted = ["".join(rng.choice(SAFE) for _ in range(32)) for _ in range(50)]
    texts = [*prose, *keys, *names, *planted]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    added = {r.doc_id for r in secret_scan.find(docs).where("n_random > 0").collect()}
    first = len(prose) + len(keys)
    assert not added & set(range(first + len(names)))
    assert len(added & set(range(first + len(names), len(texts)))) >= 48

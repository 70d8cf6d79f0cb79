"""Licence scan: the ranking by compression decides, and loses nothing."""

import random

import pytest

from tillspark.llm import licenses

WORDS = [f"{a}{b}" for a in ("lor", "ips", "dol", "amet", "con", "sed") for b in
         ("an", "em", "um", "ira", "ost", "el")]


class EveryTemplate(licenses.Scanner):
    """No ranking: every template is compared word by word."""

    def rank(self, words, among):
        return list(among)


class LeastFirst(licenses.Scanner):
    """The ranking turned round: the templates that save least."""

    def rank(self, words, among):
        last = super().rank(words, among)
        return [k for k in among if k not in last][-self.policy.winners:]


def planted():
    rng = random.Random(3)
    fill = lambda: " ".join(rng.choices(WORDS, k=rng.randrange(0, 90)))
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            for _ in range(4):
                yield name, f"{fill()} {notice} {fill()}".strip()


def names(scanner, text):
    return sorted({h[2] for h in scanner.scan(text)})


def test_ranking_loses_nothing_and_decides():
    ranked, every, least = licenses.Scanner(), EveryTemplate(), LeastFirst()
    changed = 0
    for name, text in planted():
        assert names(ranked, text) == [name]
        assert ranked.scan(text) == every.scan(text)
        changed += names(least, text) != [name]
    assert changed > 100


@pytest.mark.parametrize("text, want", [
    ("x = 1  # SPDX-License-Identifier: MIT", ["MIT"]),
    ("Distributed under the MIT license.", ["MIT"]),
    ("SPDX-License-Identifier: Foo-9.9", []),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    ("GNU Affero General Public License", []),
    ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
    ("", []), ("license " * 2000, []),
])
def test_short_notices(text, want):
    assert names(licenses.Scanner(), text) == want


def test_many_notices_in_one_window():
    tags = [f"SPDX-License-Identifier: {n}" for n in licenses.TEMPLATES]
    assert names(licenses.Scanner(), "\n".join(tags)) == sorted(licenses.TEMPLATES)


def test_repeated_rows_and_clashing_columns(spark):
    row = (1, "Released under the ISC License.", 7)
    docs = spark.createDataFrame([row, row, (None, None, None)],
                                 "doc_id long, text string, notices int")
    got = [(r.doc_id, r.licenses, r.n_notices) for r in licenses.find(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "ISC", 1), (1, "ISC", 1), (None, "", 0)], key=str)


def test_very_long_text():
    text = " ".join(WORDS * 20_000) + " Licensed under CC BY 4.0. " + " ".join(WORDS * 20_000)
    assert names(licenses.Scanner(), text) == ["CC-BY-4.0"]
